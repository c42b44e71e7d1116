"""Chat formatting from an event log: fold deltas, edits and regenerations, then render."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grievaline.llm.common import pinned, travels

travels(__name__)

# Fixed values of the template: how a turn begins and ends.
BEGIN, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
# Control strings of common templates, behind their first character.
CONTROLS = r"\|im_start\||\|im_end\||\|endoftext\||/?s>|/?INST\]|\|eot_id\||/?SYS>"

# Sequence numbers that a message may use, and how far behind an edit comes.
EVENTS, LATE = 8, 20


def escape(text: Column) -> Column:
    r"""Text in which no control string occurs: a backslash goes behind its first character.

    Backslashes that already stand there are kept, so that exactly one more is there and
    ``unescape`` takes off exactly one.
    """
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROLS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROLS})", "$1$2$3")


def event_log(conversations: DataFrame) -> DataFrame:
    """A streaming log of the table: ``conv_id, message, role, seq, kind, text``.

    What a chat service would have written for each row, told by a hash of its text:
    one delta; deltas in pieces; a draft, and an edit to the final text that comes after
    later messages have begun; a draft, a regeneration and the final deltas. ``seq``
    ascends over all events of a conversation, with gaps; ``message`` numbers its
    messages. They follow from one sort of the rows by conversation, turn, role and text,
    dealt by ranges, so that a long conversation is many tasks. Equal rows are messages of
    their own. A null text is empty, null turns come first.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = pinned(ordered.withColumn("message", F.monotonically_increasing_id()))
    half = (F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def events(*pairs):
        # numbers below EVENTS are the message's own; LATE ones lie among later messages'
        return F.array(
            *[
                F.struct(F.lit(i + (LATE if k == "edit" else 0)).alias("seq"), F.lit(k).alias("kind"), t.alias("text"))
                for i, (k, t) in enumerate(pairs)
            ]
        )

    whole, draft = F.col("text"), F.concat(F.lit("draft: "), head)
    log = (
        F.when(F.col("way") == 0, events(("delta", whole)))
        .when(F.col("way") == 1, events(("delta", head), ("delta", tail)))
        .when(F.col("way") == 2, events(("delta", draft), ("edit", whole)))
        .otherwise(events(("delta", draft), ("regenerate", F.lit("")), ("delta", head), ("delta", tail)))
    )
    return (
        placed.withColumn("way", F.pmod(F.xxhash64("text"), F.lit(4)))
        .select("conv_id", "message", "role", F.explode(log).alias("e"))
        .select("conv_id", "message", "role", (F.col("message") * EVENTS + F.col("e.seq")).alias("seq"), "e.kind", "e.text")
    )


def fold(log: DataFrame) -> DataFrame:
    """Final messages of a log: ``conv_id, message, role, text``.

    Events are sorted by the sequence of their conversation; a regeneration empties the
    text of its message, an edit replaces it, a delta is added behind it, also where
    events of other messages lie between. ``message`` begins with the sequence of the
    message's first event, which orders a conversation. The key is the message inside its
    conversation, so a conversation of any length spreads over tasks. Unknown kinds change
    nothing and a null text adds nothing.
    """
    events = F.array_sort(F.collect_list(F.struct("seq", "kind", "text")))
    # only what follows the last edit or regeneration counts, an edit itself included
    resets = F.filter("events", lambda e: e["kind"].isin("edit", "regenerate"))
    since = F.array_max(F.transform(resets, lambda e: e["seq"]))
    parts = F.transform(
        F.filter(
            F.col("events"),
            lambda e: (F.col("since").isNull() | (e["seq"] >= F.col("since"))) & e["kind"].isin("edit", "delta"),
        ),
        lambda e: F.coalesce(e["text"], F.lit("")),
    )
    return (
        log.groupBy("conv_id", "message", "role")
        .agg(events.alias("events"), F.min("seq").alias("begins"))
        .withColumn("since", since)
        .select("conv_id", F.struct("begins", "message").alias("message"), "role", F.array_join(parts, "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, message, formatted``: each message in the template, texts escaped."""
    return messages.select(
        "conv_id",
        "message",
        F.concat(
            F.lit(BEGIN), escape(F.col("role")), F.lit(BREAK), escape(F.col("text")), F.lit(END)
        ).alias("formatted"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``role``, ``text`` and the loss flag of rendered messages, from the output alone."""
    body = F.expr(f"substring(formatted, {len(BEGIN) + 1}, length(formatted) - {len(BEGIN) + len(END)})")
    role = unescape(F.expr("substring(body, 1, instr(body, '\n') - 1)"))
    text = unescape(F.expr("substring(body, instr(body, '\n') + 1, length(body))"))
    return formatted.withColumn("body", body).select(
        "conv_id",
        "message",
        "formatted",
        role.alias("role"),
        text.alias("text"),
        (role == "assistant").alias("loss"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation the turns and their digests, the text under the loss mask, sizes.

    A digest needs the text of its conversation in order, so a conversation is read by
    one task; it passes through in batches and is never held. All work before, the fold
    of the log and the rendering, is spread by message.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def close():
            n, turn, loss, text, chars = state
            out.append((key[0], n, turn.hexdigest(), loss, text.hexdigest(), chars))

        for batch in batches:
            columns = batch.columns
            ids = columns[0].to_pylist()
            for i, conv in enumerate(ids):
                if key is None or key[0] != conv:
                    if key is not None:
                        close()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss = columns[1][i].as_py(), columns[2][i].as_py(), columns[3][i].as_py()
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += columns[4][i].as_py()
            if len(out) > 1000:
                yield _rows(out)
                out = []
        if key is not None:
            close()
        yield _rows(out)

    return (
        turns.select("conv_id", "role", "text", "loss", F.length("formatted").cast("long").alias("chars"), "message")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "message")
        .select("conv_id", "role", "text", "loss", "chars")
        .mapInArrow(run, schema)
    )


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
