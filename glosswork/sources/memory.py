"""Translation memory: which texts are already translated.

A memory table has ``key_hash, lang_in, lang_out, effective_model, text,
version``; one row per key after ``memory_upsert``. A ``MemoryStore`` keeps one on
shared storage and lets it grow in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators.joins import HOT_ROWS, skew_join
from glosswork.session import written

KEY = ("key_hash", "lang_in", "lang_out", "effective_model")


def memory_lookup(segments: DataFrame, memory: DataFrame, ignore_cache: bool = False,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``memory_text``: the stored translation, NULL on a miss.

    Repeats of one text are collapsed before the memory is touched, so the big
    join sees each key once; the answer then fans out to the segments with hot
    keys salted.
    """
    if ignore_cache:
        return segments.withColumn("memory_text", F.lit(None).cast("string"))
    keys = written(segments.groupBy(*KEY).agg(F.count("*").alias("n_rows")), "memory-keys")
    # Misses stay in the list: a hot text has to be spread whether or not it is known.
    return skew_join(segments, lookup_keys(keys, memory), KEY, hot_rows=hot_rows, sizes=keys)


def lookup_keys(keys: DataFrame, memory: DataFrame) -> DataFrame:
    """Add ``memory_text`` to rows that are unique per key, as the memory is, so
    no key is hot on either side."""
    stored = memory.select(*[F.col(k).alias(f"_m_{k}") for k in KEY], F.col("text").alias("memory_text"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in KEY])
    return keys.join(stored, same, "left").drop(*[f"_m_{k}" for k in KEY])


def memory_upsert(memory: DataFrame, replies: DataFrame) -> DataFrame:
    """Memory after adding successful replies; the highest version per key wins.

    Blank texts are failures and are not stored. ``max_by`` keeps one candidate
    per key and task before the shuffle, so a key with many versions costs no
    more than any other.
    """
    fresh = replies.where(F.col("text").isNotNull() & (F.col("text") != ""))
    latest = F.max_by(F.col("text"), F.struct("version", "text"))
    return (
        memory.unionByName(fresh.select(*memory.columns))
        .groupBy(*KEY)
        .agg(latest.alias("text"), F.max("version").alias("version"))
    )


def write_memory(memory: DataFrame, root: str, version: int) -> str:
    """Write a new version directory; readers of older versions are undisturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    memory.write.mode("errorifexists").parquet(path)
    return path


class MemoryStore:
    """A memory that is added to without being rewritten.

    ``parts/part=N/bucket=B`` holds what one addition brought for the keys of a bucket, one
    row a key. ``list`` says which of them count; it has two places that are written by
    turns, after the parts, so a run that stops in between leaves the store as it was and a
    repeated addition replaces what it left. An addition writes its own rows. A bucket
    with more than ``most_parts`` parts is merged into one by ``merge``, others are not touched, so
    a row is rewritten once in ``most_parts`` additions. One writer at a time; parts
    that no longer count stay for readers of the older list, until someone removes them.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, most_parts: int = 8) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets, self.most_parts = buckets, most_parts
        spark.createDataFrame([], _LISTED).write.mode("ignore").parquet(f"{self.root}/list/slot=none")
        schema = spark.createDataFrame([], _MEMORY).schema
        self.columns = schema.names

    def add(self, replies: DataFrame) -> int:
        """Add successful replies, blank ones are left out; returns the number of the part."""
        fresh = memory_upsert(replies.select(*self.columns).where("false"), replies)
        newest, pairs = self._listed()
        return self._write(fresh, newest + 1, pairs)

    def merge(self) -> list[int]:
        """Merge the buckets that have too many parts; returns them."""
        newest, pairs = self._listed()
        parts: dict[int, list[int]] = {}
        for part, bucket in pairs:
            parts.setdefault(bucket, []).append(part)
        full = sorted(b for b, p in parts.items() if len(p) > self.most_parts)
        if full:
            rows = self._rows([(p, b) for p, b in pairs if b in set(full)])
            self._write(_latest(rows), newest + 1, [(p, b) for p, b in pairs if b not in set(full)])
        return full

    def table(self) -> DataFrame:
        """The whole memory: one row per key, the highest version."""
        return _latest(self._rows(self._listed()[1]))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``lookup_keys``, reading the buckets of these keys alone; only rows that some key
        asks for are compared by version."""
        wanted = {r["bucket"] for r in keys.select(self._bucket().alias("bucket")).distinct().collect()}
        rows = self._rows([(p, b) for p, b in self._listed()[1] if b in wanted])
        asked = keys.select(*[F.col(k).alias(f"_k_{k}") for k in KEY]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in KEY])
        return lookup_keys(keys, _latest(rows.join(asked, same, "left_semi")))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _listed(self) -> tuple[int, list[tuple[int, int]]]:
        """The number of the newest list and its (part, bucket) pairs: at most ``buckets``
        times ``most_parts`` and those added since the last merge."""
        rows = self.spark.read.schema(f"{_LISTED}, slot string").parquet(f"{self.root}/list").collect()
        newest = max((r["seq"] for r in rows), default=0)
        return newest, [(r["part"], r["bucket"]) for r in rows if r["seq"] == newest and r["part"] is not None]

    def _write(self, rows: DataFrame, part: int, pairs: list[tuple[int, int]]) -> int:
        path = f"{self.root}/parts/part={part}"
        placed = rows.select(*self.columns, self._bucket().alias("bucket"))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        filled = self.spark.read.schema(f"{_MEMORY}, bucket int").parquet(path).select("bucket").distinct().collect()
        listed = [(part, p, b) for p, b in [*pairs, *((part, r["bucket"]) for r in filled)]] or [(part, None, None)]
        self.spark.createDataFrame(listed, _LISTED).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/list/slot={part % 2}")
        return part

    def _rows(self, pairs: list[tuple[int, int]]) -> DataFrame:
        """Rows of the listed pairs; the filter is on folders alone."""
        if not pairs:
            return self.spark.createDataFrame([], _MEMORY)
        buckets: dict[int, list[int]] = {}
        for part, bucket in pairs:
            buckets.setdefault(part, []).append(bucket)
        counts = reduce(lambda a, b: a | b, [(F.col("part") == p) & F.col("bucket").isin(b) for p, b in buckets.items()])
        rows = self.spark.read.schema(f"{_MEMORY}, part int, bucket int").parquet(f"{self.root}/parts")
        return rows.where(counts).select(*self.columns)


_MEMORY = "key_hash string, lang_in string, lang_out string, effective_model string, text string, version int"
_LISTED = "seq int, part int, bucket int"


def _latest(rows: DataFrame) -> DataFrame:
    return memory_upsert(rows, rows.where("false"))
