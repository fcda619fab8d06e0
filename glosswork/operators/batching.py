"""Packing jobs into backend calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.operators.joins import is_hot
from glosswork.operators.ranking import fifo_number
from glosswork.session import written

BATCH_KEY = ("shard", "batch_no", "effective_model")


def batch_by_count(jobs: DataFrame, max_batch: int) -> DataFrame:
    """Number FIFO batches of at most ``max_batch`` jobs per shard.

    ``jobs`` has ``job_id, shard, doc_id, pos, effective_model``; the queue
    order inside a shard is ``(doc_id, pos)``, whatever type the ids have. Batches are cut before they are
    split by model, so a batch number may appear with several models. Adds
    ``batch_no`` (from 0) and ``ord`` (place within the batch).
    """
    numbered = fifo_number(jobs, part=["shard"], order=["doc_id", "pos"])
    return numbered.withColumns(
        {
            "batch_no": F.floor((F.col("rn") - 1) / max_batch).cast("bigint"),
            "ord": F.pmod(F.col("rn") - 1, F.lit(max_batch)).cast("int"),
        }
    ).drop("rn")


def build_payload(batched: DataFrame) -> DataFrame:
    """One row per backend call: member ids and the compact JSON job list.

    ``messages`` is JSON text and is embedded as it is, so unknown keys, key
    order and non-ASCII text survive. A group holds at most ``max_batch`` rows.
    """
    members = F.sort_array(F.collect_list(F.struct("ord", "job_id", "messages")))
    head = lambda m: F.to_json(F.struct(m["job_id"].alias("id")))
    entry = lambda m: F.concat(
        F.regexp_replace(head(m), r"\}$", ""), F.lit(',"messages":'), m["messages"], F.lit("}")
    )
    return batched.groupBy(*BATCH_KEY).agg(members.alias("_m")).select(
        *BATCH_KEY,
        F.transform("_m", lambda m: m["job_id"]).alias("job_ids"),
        F.concat(F.lit("["), F.array_join(F.transform("_m", entry), ","), F.lit("]")).alias("payload"),
    )


# --- batches bounded by count and by a time window anchored at the first job ---


def _micros(df: DataFrame, ts: str) -> Column:
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(ts)


def batch_by_window(
    arrivals: DataFrame,
    key: str,
    ts: str,
    order_id: str,
    max_batch: int,
    window_us: int,
    chunk_rows: int = 65_536,
) -> DataFrame:
    """Number batches per key: a job joins the open batch while it has fewer than
    ``max_batch`` jobs and the job arrived before the first one's time plus the
    window; otherwise it opens the next. Returns ``key``, ``order_id`` and
    ``batch_no`` (from 0 per key).

    Where a batch starts depends on all earlier ones, yet no key is processed in
    one piece. A hot key (more than ``chunk_rows`` rows) is cut into chunks. For
    each chunk all ``max_batch`` possible entry positions are followed to the
    chunk's end, in parallel, which yields a small map "entered here, leaves
    there, after n batches". Running through the maps gives each chunk's true
    entry; then all chunks are numbered in parallel. The result is exact.
    """
    if max_batch < 1 or window_us < 0:
        raise ValueError("max_batch must be at least 1 and the window not negative")
    chunk_rows = max(chunk_rows, max_batch)  # a batch spans at most two chunks
    narrow = arrivals.select(key, _micros(arrivals, ts).alias("_t"), order_id)

    sizes = written(narrow.groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
    hot = F.broadcast(sizes.where(is_hot(sizes, "_n", chunk_rows + 1)).select(key))

    ranked = fifo_number(
        narrow.join(hot, key, "left_semi"),
        part=[key],
        order=["_t", order_id],
        name="_rn",
    ).withColumn("_rn", F.col("_rn") - 1)
    # Read by the maps and by the numbering: the rows of hot keys are ranked once.
    chunked = written(ranked.withColumn("_chunk", F.floor(F.col("_rn") / chunk_rows)), "ranked-arrivals")

    # The last batch of a chunk may reach up to max_batch - 1 rows into the next.
    in_head = (F.col("_rn") % chunk_rows < max_batch) & (F.col("_chunk") > 0)
    with_lookahead = chunked.withColumn(
        "_chunk",
        F.explode(F.when(in_head, F.array(F.col("_chunk") - 1, F.col("_chunk"))).otherwise(F.array("_chunk"))),
    )
    key_type = arrivals.schema[key].dataType.simpleString()
    maps = (
        with_lookahead.repartition(key, "_chunk")
        .sortWithinPartitions(key, "_chunk", "_rn")
        .select(key, "_chunk", "_rn", "_t")
        .mapInPandas(
            lambda frames: _chunk_maps(frames, key, chunk_rows, max_batch, window_us),
            f"`{key}` {key_type}, _chunk bigint, leaves array<int>, batches array<bigint>",
        )
    )
    entries = (
        maps.repartition(key)
        .sortWithinPartitions(key, "_chunk")
        .mapInPandas(
            lambda frames: _chunk_entries(frames, key),
            f"`{key}` {key_type}, _chunk bigint, _enter int, _base bigint",
        )
    )
    hot_rows = chunked.join(entries, [key, "_chunk"]).select(key, "_chunk", "_t", order_id, "_enter", "_base")
    cold_rows = narrow.join(hot, key, "left_anti").select(
        key, F.lit(0).cast("bigint").alias("_chunk"), "_t", order_id,
        F.lit(0).alias("_enter"), F.lit(0).cast("bigint").alias("_base"),
    )
    id_type = arrivals.schema[order_id].dataType.simpleString()
    return (
        cold_rows.unionByName(hot_rows)
        .repartition(key, "_chunk")
        .sortWithinPartitions(key, "_chunk", "_t", order_id)
        .mapInPandas(
            lambda frames: _number_rows(frames, key, order_id, max_batch, window_us),
            f"`{key}` {key_type}, `{order_id}` {id_type}, batch_no bigint",
        )
    )


def _following(pieces: np.ndarray, times: np.ndarray, max_batch: int, window_us: int) -> np.ndarray:
    """For each row, the row that opens the next batch if this one opens one; the number of
    rows where its piece ends first. ``pieces`` numbers the stretches of rows that belong together,
    rows are sorted by piece and time."""
    n = len(times)
    # Ends of windows are sorted in among the arrivals, before those of the same time.
    order = np.lexsort((np.repeat([0, 1], n), np.concatenate([times + window_us, times]), np.tile(pieces, 2)))
    arrived = np.cumsum(order >= n)
    by_time = np.empty(n, np.int64)
    ends = order < n
    by_time[order[ends]] = arrived[ends]
    rows = np.arange(n)
    found = np.clip(np.minimum(by_time, rows + max_batch), rows + 1, None)
    last = np.append(np.flatnonzero(np.diff(pieces)) + 1, n)
    return np.where(found < last[np.searchsorted(last, rows, "right")], found, n)


def _chunk_maps(frames: Iterator[pd.DataFrame], key: str, chunk_rows: int, max_batch: int, window_us: int):
    """Per chunk: for each entry position, where the walk leaves and how many
    batches it opened. Rows come sorted; one chunk is held at a time. All walks are
    followed at once, by jumps that double in length."""
    for (k, chunk), times in _chunks(frames, key):
        own = min(chunk_rows, len(times))
        starts = np.arange(own)
        by_time = np.searchsorted(times, times[:own] + window_us, side="left")
        jump = np.clip(np.minimum(by_time, starts + max_batch), starts + 1, None)
        # Places beyond the chunk's own rows stay where they are.
        jump = np.append(jump, np.arange(own, own + max_batch + 1))
        opened = np.append(np.ones(own, np.int64), np.zeros(max_batch + 1, np.int64))
        while (jump[:own] < own).any():
            opened, jump = opened + opened[jump], jump[jump]
        width = min(max_batch, own)
        # A last chunk shorter than the entry position is skipped over whole.
        leaves = (jump[:width] - own).tolist() + [e - own for e in range(width, max_batch)]
        batches = opened[:width].tolist() + [0] * (max_batch - width)
        yield pd.DataFrame({key: [k], "_chunk": [chunk], "leaves": [leaves], "batches": [batches]})


def _chunks(frames: Iterator[pd.DataFrame], key: str):
    current, parts = None, []
    for frame in frames:
        if frame.empty:
            continue
        for ident, rows in frame.groupby([key, "_chunk"], sort=False):
            if current is not None and ident != current:
                yield current, np.concatenate(parts)
                parts = []
            current = ident
            parts.append(rows["_t"].to_numpy())
    if current is not None:
        yield current, np.concatenate(parts)


def _chunk_entries(frames: Iterator[pd.DataFrame], key: str):
    """Run through one key's maps in order; only a position and a count are kept."""
    current, enter, base = None, 0, 0
    for frame in frames:
        out = []
        for k, chunk, leaves, batches in zip(frame[key], frame["_chunk"], frame["leaves"], frame["batches"]):
            if k != current:
                current, enter, base = k, 0, 0
            out.append((k, chunk, enter, base))
            enter, base = int(leaves[enter]), base + int(batches[enter])
        yield pd.DataFrame(out, columns=[key, "_chunk", "_enter", "_base"])


def _number_rows(frames: Iterator[pd.DataFrame], key: str, order_id: str, max_batch: int, window_us: int):
    """Number the rows of each chunk from its entry, all chunks of a frame at once; a chunk
    that a frame cuts off is held until it is whole."""
    held = None
    for frame in frames:
        if frame.empty:
            continue
        rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
        piece = _pieces(rows, key)
        whole = int(np.searchsorted(piece, piece[-1]))
        held = rows.iloc[whole:]
        if whole:
            yield _numbered(rows.iloc[:whole], piece[:whole], key, order_id, max_batch, window_us)
    if held is not None:
        yield _numbered(held, _pieces(held, key), key, order_id, max_batch, window_us)


def _pieces(rows: pd.DataFrame, key: str) -> np.ndarray:
    """Numbers the runs of equal key and chunk; null keys are equal."""
    keys, chunks = rows[key], rows["_chunk"]
    before = keys.shift()
    same = (keys == before) | (keys.isna() & before.isna())
    return np.cumsum((~same | (chunks != chunks.shift())).to_numpy(bool))


def _numbered(rows: pd.DataFrame, piece: np.ndarray, key: str, order_id: str, max_batch: int, window_us: int):
    n = len(rows)
    jump = np.append(_following(piece, rows["_t"].to_numpy(np.int64), max_batch, window_us), n)
    first = np.flatnonzero(np.append(True, np.diff(piece) > 0))
    enter = first + rows["_enter"].to_numpy(np.int64)[first]
    # The entry may lie beyond a short last chunk: then no batch opens in it.
    last = np.append(first[1:], n)
    opens = np.zeros(n + 1, bool)
    opens[enter[enter < last]] = True
    # Whoever is reached opens a batch; jumps double until all lead out.
    while (jump[:n] < n).any():
        opens[jump[np.flatnonzero(opens[:n])]] = True
        jump = jump[jump]
    opened = np.cumsum(opens[:n])
    before = np.append(0, opened)[first]
    numbers = rows["_base"].to_numpy(np.int64) - 1 + opened - np.repeat(before, last - first)
    return pd.DataFrame({key: rows[key], order_id: rows[order_id], "batch_no": numbers})
