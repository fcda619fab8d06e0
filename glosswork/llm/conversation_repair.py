"""Conversation structure repair by depth-first branch-and-bound.

A conversation should be empty, or an optional system row and then user and assistant
rows by turns, user first and assistant last. Each row is kept (K), given the other
speaker's role (R) or deleted (D), and empty rows can be inserted (I) anywhere; the
cheapest edits win, the least audit (their letters in order) among equals.

The search walks rows depth first with an explicit stack. A node is a row and the state
of the grammar before it. A prefix is dropped if its cost and the lower bound of the
suffix exceed the incumbent (cost, audit), if they equal it with a greater audit, or if
the table of its node has a better prefix. The bound relaxes the problem: the rest may
end in any state that can still reach the goal. When the stack is empty, the incumbent
is proved best.

Rows are numbered by a distributed sort, faults are found by grouping, and of a row the
search sees one letter. A conversation is cut into blocks of BLOCK rows: each block is
searched for every state that it may be entered and left in, and neighbouring blocks
are put together, FAN at a time. So no task holds the rows of a long conversation; the
audit is one value, as it must be. The digest of a repaired conversation needs its texts
one after the other: they pass one task as a sorted stream that keeps no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm.numbering import numbered, same
from glosswork.session import written

BLOCK = 512
FAN = 32
# Fixed values of the contract: costs, the white space of a blank, what ends a sentence.
RETITLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
ASCII_SPACE = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"

# States: nothing said yet, after the system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = STATES = "-sua"
DONE = (NONE, ASSISTANT)
_NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_SPEAKER = {NONE: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # who may speak next
_NEVER = float("inf")
# Letters of rows by initial (s, u, a or another) and fault: none, cut short, to be deleted.
_LETTERS = ("suax", "SUAX", "0123")


def _steps(letter: str, state: str) -> list[tuple[str, int, str]]:
    """Edits of a row in a state: letter, cost, next state."""
    steps = [("D", DELETE, state)]
    if letter in _LETTERS[2]:
        return steps
    extra = CUT_SHORT if letter in _LETTERS[1] else 0
    kept = _NEXT.get((state, letter.lower()))
    if kept:
        steps.append(("K", extra, kept))
    return [*steps, ("R", RETITLE + extra, _NEXT[state, _SPEAKER[state]])]


def _bounds(letters: str, goal: tuple[str, ...]) -> list[dict[str, float]]:
    """Least cost from each row and state to any ending from which the goal is no contradiction."""
    spoken = {USER, ASSISTANT} & set(goal)
    ending = {state: 0 if spoken or state in goal else _NEVER for state in STATES}
    bounds = [ending]
    for letter in reversed(letters):
        after = bounds[-1]
        here = {state: min(cost + after[then] for _, cost, then in _steps(letter, state)) for state in STATES}
        for _ in range(2):  # two inserts change any state into any that follows it
            here = {s: min(here[s], INSERT + here[_NEXT[s, _SPEAKER[s]]]) for s in STATES}
        bounds.append(here)
    return bounds[::-1]


def search(letters: str, start: str = NONE, goal: tuple[str, ...] = DONE) -> tuple[int, str] | None:
    """The best (cost, audit) from a state to one of the goal's, None if there is no way."""
    bounds = _bounds(letters, goal)
    incumbent: tuple[int, str] | None = None
    best_at: dict[tuple[int, str], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        least = cost + bounds[row][state]
        if least == _NEVER or (incumbent and (
                least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][: len(audit)]))):
            continue
        known = best_at.get((row, state))
        if known and known <= (cost, audit):
            continue
        best_at[row, state] = cost, audit
        if row == len(letters) and state in goal and (not incumbent or (cost, audit) < incumbent):
            incumbent = cost, audit
        moves = [(row, _NEXT[state, _SPEAKER[state]], INSERT, "I")]
        if row < len(letters):
            moves += [(row + 1, then, price, edit) for edit, price, then in _steps(letters[row], state)]
        moves.sort(key=lambda m: (m[2] + bounds[m[0]][m[1]], m[3]), reverse=True)
        stack += [(at, then, cost + price, audit + edit) for at, then, price, edit in moves]
    return incumbent


def illegal_pairs(letters: str) -> int:
    """Neighbours other than system-user, user-assistant and assistant-user."""
    plain = letters.translate(str.maketrans("".join(_LETTERS), _LETTERS[0] * 3))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))


# A block or several together: the first and the last letter, illegal pairs, and the best way
# from each state it may be entered in to each state it may be left in.
_PIECE = T.StructType().add("ends", "string").add("illegal", "long").add("ways", T.ArrayType(
    T.StructType().add("start", "string").add("stop", "string").add("cost", "long").add("audit", "string")))
_WAY = pa.struct([("start", pa.string()), ("stop", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def _piece(letters: str, first: bool, only: bool) -> dict:
    ways = []
    for start in (NONE if first else STATES):
        for goal in ([DONE] if only else STATES):
            found = search(letters, start, tuple(goal))
            if found:
                ways.append({"start": start, "stop": goal[-1], "cost": found[0], "audit": found[1]})
    return {"ends": letters[0] + letters[-1], "illegal": illegal_pairs(letters), "ways": ways}


def _together(left: dict, right: dict) -> dict:
    best: dict[tuple[str, str], tuple[int, str]] = {}
    for a in left["ways"]:
        for b in right["ways"]:
            if a["stop"] == b["start"]:
                way = a["cost"] + b["cost"], a["audit"] + b["audit"]
                key = a["start"], b["stop"]
                best[key] = min(best.get(key, way), way)
    return {
        "ends": left["ends"][0] + right["ends"][1],
        "illegal": left["illegal"] + right["illegal"] + illegal_pairs(left["ends"][1] + right["ends"][0]),
        "ways": [{"start": s, "stop": t, "cost": c, "audit": a} for (s, t), (c, a) in best.items()],
    }


def rows_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as a written table with ``place`` (from 0 by turn, nulls
    first, then role and digest of the text), ``of`` and what the faults need. Null roles
    and texts are one space, other columns are left out."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    rows = rows.select(
        "*", F.sha2(F.col("text").cast("binary"), 256).alias("text_key"),
        (bare == "").alias("is_blank"), (~F.right(bare, F.lit(1)).isin(*SENTENCE_ENDS)).alias("is_cut"))
    return written(
        numbered(rows, ["conv_id"], ["turn", "role", "text_key"]).withColumn("block", F.expr(f"place div {BLOCK}L")),
        "conversation-rows")


def faults(rows: DataFrame) -> DataFrame:
    """One row of a numbered conversation each: ``fault`` (blank, duplicate, truncated or
    null, the first that holds) and ``letter``. A duplicate has the role and text of an
    earlier row; which rows are the first of their kind is found by grouping."""
    said = ["conv_id", "role", "text_key"]
    plain = rows.select(*said, "place", "of", "block", "is_blank", "is_cut")
    repeated = plain.where("NOT is_blank").groupBy(*said).agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = plain.alias("p").join(repeated.alias("r"), same(said, "p", "r"), "left").select(
        "p.conv_id", "p.place", "p.of", "p.block", "p.role",
        F.expr("CASE WHEN is_blank THEN 'blank' WHEN place > first THEN 'duplicate' WHEN is_cut THEN 'truncated' END").alias("fault"))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), F.instr(F.lit("sua"), initial)).otherwise(4)
    letters = F.when(F.col("fault").isNull(), _LETTERS[0]).when(F.col("fault") == "truncated", _LETTERS[1]).otherwise(_LETTERS[2])
    return marked.withColumn("letter", F.substring(letters, kind, F.lit(1)))


def solve(found: DataFrame) -> DataFrame:
    """``conv_id``, ``illegal``, ``cost`` and ``audit`` of every conversation of ``faults``."""
    blocks = written(
        found.groupBy("conv_id", "block", "of").agg(F.sort_array(F.collect_list(F.struct("place", "letter"))).alias("l"))
        .select("conv_id", "block", F.expr(f"(of + {BLOCK - 1}L) div {BLOCK}L").alias("blocks"),
                F.array_join("l.letter", "").alias("letters")),
        "conversation-blocks")
    schema = T.StructType([blocks.schema["conv_id"], blocks.schema["block"], blocks.schema["blocks"], *_PIECE])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [{"conv_id": r["conv_id"], "block": r["block"], "blocks": r["blocks"],
                     **_piece(r["letters"], r["block"] == 0, r["blocks"] == 1)} for r in batch.to_pylist()]
            yield _pieces(made, batch.schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for schema, runs in _grouped(batches, lambda r: (r["conv_id"], r["block"] // FAN)):
            for (conv_id, block), rows in runs:
                first = next(rows)
                whole = {k: first[k] for k in ("ends", "illegal", "ways")}
                for row in rows:
                    whole = _together(whole, row)
                yield _pieces([{"conv_id": conv_id, "block": block, "blocks": -(-first["blocks"] // FAN), **whole}], schema)

    pieces = written(blocks.mapInArrow(searched, schema), "searched-blocks")
    most = pieces.agg(F.max("blocks")).first()[0] or 1
    done = pieces.where("blocks = 1")
    while most > 1:
        several = pieces.where("blocks > 1").withColumn("_to", F.expr(f"block div {FAN}L"))
        # Small rows, but their audits grow: written, so that a lost task repeats one round.
        pieces = written(
            several.repartition("conv_id", "_to").sortWithinPartitions("conv_id", "block").drop("_to").mapInArrow(joined, schema),
            "joined-blocks")
        done = done.unionByName(pieces.where("blocks = 1"))
        most = -(-most // FAN)
    # Both ways to end count: with an assistant row, or with nothing at all.
    best = F.array_min(F.transform(
        F.filter("ways", lambda w: (w["start"] == NONE) & w["stop"].isin(*DONE)), lambda w: F.struct(w["cost"], w["audit"])))
    return done.select("conv_id", "illegal", best.alias("best")).select("conv_id", "illegal", "best.cost", "best.audit")


def _pieces(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        schema.field("conv_id"), ("block", pa.int64()), ("blocks", pa.int64()), ("ends", pa.string()),
        ("illegal", pa.int64()), ("ways", pa.list_(_WAY))]))


def _grouped(batches: Iterator[pa.RecordBatch], key) -> Iterator[tuple[pa.Schema, Iterator]]:
    """The schema and the runs of rows of equal key of a sorted stream; nothing if it is empty."""
    first = next(batches, None)
    if first is not None:
        def rows():
            yield from first.to_pylist()
            for batch in batches:
                yield from batch.to_pylist()
        yield first.schema, groupby(rows(), key=key)


def _with_audits(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows, and before those of each block a row with the block's part of the audit in
    ``text`` and in ``place`` the number of rows said before it. The grammar
    leaves one role for each of them: the first is the system's if their number is odd."""
    fields = [rows.schema["conv_id"]]
    schema = T.StructType(fields).add("block", "long").add("said", "long").add("odd", "boolean").add("audit", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.select(["conv_id", "audit"]).to_pylist():
                audit, block, said = row["audit"], 0, 0
                odd = (len(audit) - audit.count("D")) % 2 == 1
                while audit:
                    end = _after_rows(audit, BLOCK)
                    made.append({"conv_id": row["conv_id"], "block": block, "said": said, "odd": odd, "audit": audit[:end]})
                    said += end - audit.count("D", 0, end)
                    audit, block = audit[end:], block + 1
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([
                batch.schema.field("conv_id"), ("block", pa.int64()), ("said", pa.int64()), ("odd", pa.bool_()), ("audit", pa.string())]))

    heads = solved.select("conv_id", "audit").mapInArrow(cut, schema)
    return rows.select("conv_id", "block", "place", "turn", "role", "text").unionByName(
        heads.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)


def _after_rows(audit: str, rows: int) -> int:
    """Where the audit of so many rows ends; inserts at the very end belong to the last row."""
    at = seen = 0
    while at < len(audit) and seen < rows:
        seen += audit[at] != "I"
        at += 1
    return len(audit) if not audit[at:].strip("I") else at


def _spoken(rows: Iterator[dict]) -> Iterator[dict]:
    """The repaired rows of a stream of blocks, each with its part of the audit before its rows."""
    part, at, last, said, odd = "", 0, 0, 0, False

    def speak(row: dict, edit: str) -> dict:
        role = row["role"] if edit == "keep" else ("user", "assistant")[(said - odd) % 2]
        new = edit == "insert"
        return {"conv_id": row["conv_id"], "at": said, "role": role, "text": "" if new else row["text"],
                "edit": edit, "turn": None if new else row["turn"]}

    for row in rows:
        if row["place"] == -1:
            part, at, said, odd = row["audit"], 0, row["said"], row["odd"]
            last = len(part.rstrip("I"))
            continue
        while part[at] == "I":
            yield speak(row, "insert")
            at, said = at + 1, said + 1
        if part[at] != "D":
            yield speak(row, "keep" if part[at] == "K" else "rerole")
            said += 1
        at += 1
        if at == last:
            for _ in part[last:]:
                yield speak(row, "insert")
                said += 1


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, at`` (from 0)``, role, text, edit`` (keep, rerole or
    insert) and ``turn`` of the row it comes from. Blocks are rewritten apart."""
    mixed = _with_audits(rows, solved).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    kinds = {f.name: f for f in rows.schema}
    schema = T.StructType([kinds["conv_id"]]).add("at", "long").add("role", "string").add("text", "string").add(
        "edit", "string").add(kinds["turn"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, runs in _grouped(batches, lambda r: None):
            out = pa.schema([types.field("conv_id"), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                             ("edit", pa.string()), types.field("turn")])
            made = []
            for _, stream in runs:
                for row in _spoken(stream):
                    made.append(row)
                    if len(made) == 1000:
                        yield pa.RecordBatch.from_pylist(made, schema=out)
                        made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=out)

    return mixed.mapInArrow(rewrite, schema)


def repaired_digests(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``, of ``role:text`` of the repaired rows, joined by newlines."""
    mixed = _with_audits(rows, solved).repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")
    schema = T.StructType([rows.schema["conv_id"]]).add("repaired_sha256", "string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, runs in _grouped(batches, lambda r: r["conv_id"]):
            out = pa.schema([types.field("conv_id"), ("repaired_sha256", pa.string())])
            for conv_id, stream in runs:
                state = hashlib.sha256()
                for n, row in enumerate(_spoken(stream)):
                    state.update(f"{chr(10) if n else ''}{row['role']}:{row['text']}".encode())
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "repaired_sha256": state.hexdigest()}], schema=out)

    return mixed.mapInArrow(hashed, schema)


def report(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: ``gaps`` (missing turn numbers), ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    ``every`` (a table with ``conv_id``) adds conversations without rows: zeros, an empty
    audit and the digest of nothing. Null conversation ids are one conversation; null turns come
    first and are no gap; rows of one turn are ordered by role and digest of the text, so repeated
    rows are neighbours. A role counts by its first character; one without any fits nowhere.
    An empty table gives an empty one.
    """
    rows = rows_of(conversations)
    found = written(faults(rows), "conversation-faults")
    solved = written(solve(found), "conversation-audits")
    is_fault = lambda name: F.sum((F.col("fault") == name).cast("long")).alias(name)
    # The facts of a conversation come from several places; one grouping puts them side by side.
    facts = [
        found.groupBy("conv_id").agg(*map(is_fault, ("blank", "duplicate", "truncated"))),
        rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps")),
        solved,
        repaired_digests(rows, solved),
        *([every.select("conv_id").distinct()] if every is not None else []),
    ]
    merged = facts[0]
    for more in facts[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    count = lambda name: F.coalesce(F.max(name), F.lit(0)).cast("long").alias(name)
    return merged.groupBy("conv_id").agg(
        *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """A damaged copy to try the repair on: by checksum of ``conv_id:turn``, one row in twenty
    each is dropped, emptied, robbed of its sentence ends, repeated, or given to the user.
    Nulls count as one space."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return (
        conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), lot.alias("lot"))
        .where("lot <> 0")
        .withColumn("copy", F.explode(F.expr("array_repeat(0, if(lot = 3, 2, 1))")))
        .select(
            "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"))
    )
