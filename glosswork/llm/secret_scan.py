"""Secret scan with an incremental blob ledger, in DataFrame functions only.

A blob is a text, addressed by its SHA-256. The ledger is a table of the pairs (blob,
rule version) that were scanned, with what was found. A run scans each blob that has
an unseen pair once, for its unseen rules only, appends to the ledger, and joins the
findings back to every row that carries the blob. Copies and unchanged versions cost
one digest.

Where a match lies is counted from the pieces between the matches of a rule, in code
points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import let, starts_of, text_of

FOUND = "array<struct<start: int, kind: int, end: int>>"
LEDGER = f"address binary, rule string, version int, spans {FOUND}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose ``group``
    has under ``least`` characters are dropped after matching."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# Fixed values of the contract. A run of hex digits or of capitals is taken whole
# either way, so the least length is part of those two patterns.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
# Public formats of other providers.
MORE_RULES = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def spans(text: Column, rule: Rule, order: int) -> Column:
    """All matches of a rule as (start, order of the kind, end), from the left."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast(FOUND)
    lengths = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    # One more piece than matches; a step is a piece and the match after it.
    steps = F.filter(
        F.arrays_zip(pieces.alias("piece"), lengths(0).alias("match"), lengths(rule.group).alias("kept")),
        lambda s: s["match"].isNotNull())
    found = let(steps, lambda known: F.transform(
        F.filter(
            F.zip_with(known, starts_of(F.transform(known, lambda s: s["piece"] + s["match"])), lambda s, at: F.struct(
                (at + s["piece"]).alias("start"), (at + s["piece"] + s["match"]).alias("end"), s["kept"].alias("kept"))),
            lambda m: m["kept"] >= rule.least),
        lambda m: F.struct(m["start"], F.lit(order).alias("kind"), m["end"])))
    return F.when(F.rlike(text, pattern), found).otherwise(none)


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_unseen(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows: (address, rule, version, spans) for every pair of a text of
    ``docs`` and a rule version that ``ledger`` lacks. Null texts are empty; a text
    without findings has rows too, with no spans. No documents, no rows."""
    blobs = docs.select(text_of(text_col).alias("text")).withColumn("address", address(F.col("text"))).dropDuplicates(["address"])
    asked = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    seen = ledger.groupBy("address").agg(
        F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen")  # at most one entry a rule version
    )
    pending = (
        blobs.join(seen, "address", "left")
        .withColumn("asked", F.array_except(asked, F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("asked") > 0)
    )
    scanned = F.array(*[
        F.when(F.array_contains("asked", f"{r.kind}:{r.version}"), F.struct(
            F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r, k).alias("spans")))
        for k, r in enumerate(rules)
    ])
    return (
        pending.select("address", F.explode(F.filter(scanned, lambda x: x.isNotNull())).alias("row"))
        .select("address", "row.rule", "row.version", "row.spans")
    )


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Append what is unseen to the ledger table at ``path`` and return the whole ledger."""
    spark = docs.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
    except Exception as error:  # the first run
        if "PATH_NOT_FOUND" not in str(error):
            raise
        ledger = empty_ledger(spark)
    scan_unseen(docs, ledger, rules, text_col).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text but with ``secrets``: (start, kind, end)
    of the given rule versions, by start, then kind. Copies get the same findings,
    repeated rows each their own; a column ``secrets`` of the input is replaced."""
    wanted = [f"{r.kind}:{r.version}" for r in rules]
    found = (
        ledger.where(F.concat_ws(":", "rule", "version").isin(wanted) & (F.size("spans") > 0))
        .groupBy("address").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("_found"))
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "secrets")]
    kind = F.array(*[F.lit(r.kind) for r in rules])
    return (
        docs.select(*kept, address(text_of(text_col)).alias("_address"))
        .join(found.withColumnRenamed("address", "_address"), "_address", "left")
        .select(*kept, F.transform(
            F.coalesce("_found", F.array().cast(FOUND)),
            lambda s: F.struct(s["start"].alias("start"), F.get(kind, s["kind"]).alias("kind"), s["end"].alias("end")),
        ).alias("secrets"))
    )


def joined(secrets: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
