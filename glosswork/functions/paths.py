"""Lexical path expressions for POSIX paths held in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.text import js_strip


def has_pdf_suffix(path: Column) -> Column:
    """Suffix ``.pdf`` in any case on a name that has something before the dot."""
    return F.coalesce(path.rlike(r"(?i)[^/]\.pdf\z"), F.lit(False))


def resolve(path: Column, root: Column) -> Column:
    """Absolute form of ``path`` with ``.`` and ``..`` removed; relative paths
    start at ``root``; NULL and empty stay NULL."""
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path))
    parts = F.filter(F.split(absolute, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, p)),
    )
    return F.when(path != "", F.concat(F.lit("/"), F.array_join(kept, "/")))


def confined_folder(folder: Column, root: Column, default: str) -> Column:
    """Absolute form of an output folder that has to be relative and lie inside
    ``root``; NULL where it does not. A blank folder is ``default``."""
    named = F.coalesce(F.nullif(js_strip(folder), F.lit("")), F.lit(default))
    path = resolve(named, root)
    return F.when(~named.startswith("/") & relative_inside(path, root).isNotNull(), path)


def relative_inside(path: Column, root: Column) -> Column:
    """Path below ``root`` relative to it, NULL if it is outside. Whole segments
    are compared, so ``/out`` does not contain ``/outside``. ``/`` contains all."""
    base = F.rtrim(root, F.lit("/"))
    return F.when(path == base, F.lit("")).when(
        path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))
    )
