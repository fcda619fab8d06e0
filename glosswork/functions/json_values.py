"""Type-exact JSON checks on VARIANT.

``from_json`` with a fixed schema is not usable here: it turns a number into a
string where the contract says "skip it", and one odd array element nulls the
whole record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.frames import compute_once


# Fixed value: Spark's limit for one VARIANT. Longer texts are read by members.
VARIANT_BYTES = 128 * 1024 * 1024
# JSON alone, no extensions of it, and strings of any length.
_PLAIN_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxStringLen": str(2**31 - 1)}


def too_large(text: Column) -> Column:
    """Whether a text is over what can be parsed as one VARIANT, whatever it says."""
    return F.octet_length(text) > VARIANT_BYTES


def _boxed(text: Column, mark: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))


def _unboxed(boxed: Column, mark: Column) -> Column:
    complete = F.try_variant_get(boxed, "$[1]", "bigint") == mark
    return F.when(complete, F.try_variant_get(boxed, "$[0]", "variant"))


def strict_json(text: Column) -> Column:
    """Parse a complete JSON document, NULL if it is not one.

    ``try_parse_json`` stops after the first value and ignores what follows, so
    ``{...} trailing words`` would pass. The text is therefore parsed inside an
    array that ends with the text's own hash: only if the parser reaches that
    hash as second element was the text exactly one JSON value.
    """
    mark = F.xxhash64(text)
    return _unboxed(_boxed(text, mark), mark)


def record_json(text: Column, members: Sequence[str]) -> Column:
    """``strict_json`` for an object of which only ``members`` are used, at any length.

    A text over the limit is read as a stream that keeps these members and passes over
    all others, so its value has them alone; a value that is no object becomes a JSON
    null. The hash at the end of the array tells that the text was one complete value.
    """
    mark = F.xxhash64(text)
    boxed = F.concat(F.lit("["), text, F.lit(',{"_mark":'), mark.cast("string"), F.lit("}]"))
    fields = ", ".join(f"`{m}` variant" for m in members)
    found = F.from_json(boxed, f"array<struct<{fields}, `_mark` bigint>>", _PLAIN_JSON)
    value = F.get(
        F.transform(F.array(found), lambda v: F.when(
            (F.size(v) == 2) & (F.get(v, F.lit(1))["_mark"] == mark),
            F.coalesce(F.to_json(F.get(v, F.lit(0)).dropFields("_mark")), F.lit("null")))),
        F.lit(0))
    other = F.get(
        F.transform(F.array(F.from_json(boxed, "array<string>", _PLAIN_JSON)), lambda v: F.when(
            (F.size(v) == 2) & (F.get(v, F.lit(1)) == F.concat(F.lit('{"_mark":'), mark.cast("string"), F.lit("}"))), F.lit("null"))),
        F.lit(0))
    is_record = F.ltrim(text, F.lit(" \t\r\n")).startswith("{")
    by_members = F.try_parse_json(F.when(is_record, value).otherwise(other))
    return F.when(too_large(text), by_members).otherwise(strict_json(text))


def with_json(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the parsed ``text`` as a column. Same as ``strict_json``, but each
    step is its own projection, so a long text is stripped, hashed and parsed
    once however often its value is used."""
    steps = df.withColumn("_text", text).withColumn("_mark", F.xxhash64("_text"))
    steps = steps.withColumn("_boxed", _boxed(F.col("_text"), F.col("_mark")))
    return compute_once(steps, {name: _unboxed(F.col("_boxed"), F.col("_mark"))}).drop("_text", "_mark", "_boxed")


def child(value: Column, path: str) -> Column:
    """Member at ``path`` as VARIANT: SQL NULL if absent, variant null if null."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """``STRING``, ``BIGINT``, ``VOID`` (JSON null), ``OBJECT<..>`` ...; SQL NULL
    where the value is absent."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT<"), F.lit(False))


def is_json_null(value: Column) -> Column:
    return F.coalesce(kind(value) == "VOID", F.lit(False))


def string_only(value: Column) -> Column:
    """The value if it is a JSON string, else NULL."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def elements(value: Column, path: str) -> Column:
    """Array at ``path`` as ``array<variant>``, NULL if it is no array."""
    return F.try_variant_get(value, path, "array<variant>")


def number(value: Column) -> Column:
    """Numeric value as double; booleans count as 1 and 0, as in Python."""
    k = kind(value)
    return (
        F.when(k == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(k.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    )


def truthy_text(value: Column) -> Column:
    """Text of a value that Python counts as true, else NULL."""
    k = kind(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(k == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), F.lit("True")))
        .when(k == "STRING", F.when(text != "", text))
        .when(k == "BIGINT", F.when(number(value) != 0, text))
        # A number with a point or an exponent prints as a float.
        .when(k.rlike("^(DOUBLE|DECIMAL)"), F.when(number(value) != 0, number(value).cast("string")))
        .when(k.isin("OBJECT<>", "ARRAY<VOID>"), F.when(~F.to_json(value).isin("{}", "[]"), F.to_json(value)))
        .when(k.rlike("^(OBJECT|ARRAY)"), F.to_json(value))
    )
