"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation log is a table of events. It is partitioned by message place, sorted
by sequence and folded into final messages; the messages of a conversation are then
rendered with a loss mask. Partial collection inside the tasks comes first, and a
busy conversation is spread over its turns until its few final messages meet. A
rendered conversation is one value, as its text must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.common import starts_of

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    """No ``<`` is left, so no text can hold a marker; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as an event log."""
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"),
        F.col("turn").cast("long").alias("turn"), "role", "text",
    )


def fold_events(log: DataFrame) -> DataFrame:
    """``conv_id`` and ``messages`` (array of turn, role, text) from a log of
    ``conv_id, seq, kind, turn, role, text``.

    Kinds, applied in order of ``seq`` (ties: kind, role, text): ``message`` starts a
    message with its text; ``delta`` appends to the newest message of its turn;
    ``edit`` replaces that message's text; ``regenerate`` empties it and discards
    what was said in later turns until then. An event without an earlier ``message``
    starts one. Null texts and roles are empty, nulls in ``turn`` and ``seq`` come
    first, repeated rows all count, other kinds are ignored, other columns too.
    """
    event = F.struct(
        F.col("seq").cast("long").alias("seq"),
        # A message precedes its deltas where the sequence number is the same.
        F.array_position(F.array(*map(F.lit, ("message", "edit", "regenerate", "delta"))), F.col("kind")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    known = log.where(F.col("kind").isin("message", "edit", "regenerate", "delta"))
    places = known.groupBy("conv_id", F.col("turn").cast("long").alias("turn")).agg(
        F.sort_array(F.collect_list(event)).alias("events"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq").cast("long"))).alias("regenerated"),
    )
    # What a later regeneration of an earlier turn leaves: a running maximum over the turns.
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max(F.when(F.col("turn").isNotNull(), F.col("regenerated"))).over(earlier)
    left = places.withColumn("cut", cut).select("conv_id", "turn", F.when(F.col("cut").isNull(), F.col("events")).otherwise(
        F.filter("events", lambda e: F.col("cut") <= F.coalesce(e["seq"], F.lit(-2**63 + 1)))).alias("events"))
    together = (
        left.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "events"))).alias("places"))
        # Where messages start.
        .withColumn("places", F.expr("""
            transform(places, p -> struct(p.turn AS turn, p.events AS events, if(size(p.events) = 0, array(),
              filter(sequence(1, size(p.events)), i -> i = 1 OR element_at(p.events, i).kind = 1)) AS starts))"""))
        .withColumn("parts", F.expr("""
            flatten(transform(places, p -> transform(p.starts, (s, k) -> struct(p.turn AS turn, slice(p.events, s,
              coalesce(get(p.starts, k + 1), size(p.events) + 1) - s) AS events))))"""))
    )
    # Only what follows the last replacement is part of the text.
    return together.select("conv_id", F.expr("""
        transform(
          transform(parts, p -> struct(p.turn AS turn, p.events[0].role AS role, slice(p.events,
            array_max(transform(p.events, (e, i) -> if(e.kind < 4 OR i = 0, i + 1, 0))), size(p.events)) AS rest)),
          p -> struct(p.turn AS turn, p.role AS role,
            array_join(transform(p.rest, e -> if(e.kind = 3, '', e.text)), '') AS text))""").alias("messages"))


def render(conversations: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (start, length in code points) of
    folded conversations. Texts of ``learned_role`` are under the loss mask, without
    their markers. No messages give an empty text and no spans."""
    parts = conversations.select("conv_id", F.transform("messages", lambda m: F.struct(
        F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n")).alias("head"),
        escape(m["text"]).alias("body"),
        (m["role"] == learned_role).alias("learned"),
    )).alias("parts"))
    starts = starts_of(F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)))
    spans = F.filter(
        F.zip_with("parts", starts, lambda p, at: F.when(p["learned"], F.struct(
            (at + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))),
        lambda s: s.isNotNull())
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return parts.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``messages`` (role, text) and ``learned`` (the texts under the mask),
    taken from the formatted text and the spans alone. Turns and spans meet where a turn's
    text starts; a span that starts elsewhere is lost, and the digests show it."""
    turns = rendered.select("conv_id", F.filter(F.split("formatted", CLOSE, -1), lambda t: t != "").alias("turns"))
    starts = starts_of(F.transform("turns", lambda t: F.length(t) + len(CLOSE)))
    said = turns.select("conv_id", F.inline(F.arrays_zip(F.col("turns").alias("turn"), starts.alias("at")))).withColumn(
        "head", F.instr("turn", "\n"))
    spans = rendered.select("conv_id", F.inline("loss_spans"))
    rows = (
        said.select("conv_id", (F.col("at") + F.col("head")).alias("at"),
                    F.struct(F.expr(f"substring(turn, {len(OPEN) + 1}, head - {len(OPEN) + 1})").alias("role"),
                             F.expr("substring(turn, head + 1)").alias("body")).alias("turn"))
        .unionByName(spans.select("conv_id", F.col("start").alias("at"), "length"), allowMissingColumns=True)
        .unionByName(rendered.select("conv_id", F.lit(-1).alias("at"), "formatted"), allowMissingColumns=True)
    )
    met = rows.groupBy("conv_id", "at").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("turn", "length", "formatted")])
    whole = met.groupBy("conv_id").agg(
        F.first("formatted", ignorenulls=True).alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("at", "turn", "length")))).alias("turns"))
    return whole.select(
        "conv_id", "formatted",
        F.transform("turns", lambda t: F.struct(
            unescape_role(t["turn"]["role"]).alias("role"), unescape(t["turn"]["body"]).alias("text"))).alias("messages"),
        F.transform(F.filter("turns", lambda t: t["length"].isNotNull()), lambda t: unescape(
            F.substring(t["turn"]["body"], F.lit(1), t["length"]))).alias("learned"),
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What is read back from the output, as counts and digests."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    loss = F.array_join("learned", "")
    return read_back(rendered).select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
