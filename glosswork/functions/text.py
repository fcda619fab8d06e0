"""Whitespace, hashing and tail expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip() and JavaScript's String.trim() remove.
_COMMON_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
PY_SPACE = _COMMON_SPACE + "\x1c\x1d\x1e\x1f\x85"
JS_SPACE = _COMMON_SPACE + "\ufeff"


def py_strip(text: Column) -> Column:
    """Python ``str.strip``. A trim with a character set is linear in the text,
    unlike an anchored regular expression."""
    return F.btrim(text, F.lit(PY_SPACE))


def js_strip(text: Column) -> Column:
    """JavaScript ``String.trim`` (also drops a byte order mark)."""
    return F.btrim(text, F.lit(JS_SPACE))


def first_filled(*texts: Column) -> Column:
    """First argument that is neither NULL nor empty."""
    return F.coalesce(*[F.when(t != "", t) for t in texts])


def text_key(text: Column) -> Column:
    """Identity of a text in dedup and translation memory."""
    return F.sha2(text, 256)


def tail(text: Column, n: int) -> Column:
    """Last ``n`` characters."""
    return F.right(text, F.lit(n))


def json_quote(text: Column) -> Column:
    """The text as a JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("s")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
