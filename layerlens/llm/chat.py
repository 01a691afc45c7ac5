"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, and
only its reply is trainable.  Written out, the examples of one conversation grow
with the square of its turns, so contexts are shared: ``format_turns`` gives one
formatted segment a turn, and ``examples`` explodes every assistant turn into its
own row, with the target's segment, the loss span in it, and its context by
reference, as the length of the conversation's text before it; ``read_back``
digests both tables.  ``expanded`` writes examples out in full, and
``read_expanded`` digests conversations from these alone.

Template: ``<|im_start|>role\ntext<|im_end|>\n``.  Inside roles and texts ``<|``
becomes ``<||``, and line ends in roles become ``<|nl|>``, so control strings
never come from content and both can be undone.  Null roles and texts count as
empty.  Turns that tie are ordered by role, then text; repeated rows are turns of
their own.  An empty table gives empty results.  A conversation is streamed
through one task in order, as its digests need; memory holds one turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def format_turns(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row a turn: conv_id, pos, segment, is_target, seg_start, loss_start, loss_end (offsets in the conversation's text, in code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), F.replace(escape(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    body = escape(text)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id", "turn", "role", "text", F.concat(head, body, F.lit(TAIL)).alias("segment"), F.length(head).alias("_head"), F.length(body).alias("_body"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"pos": F.count(F.lit(1)).over(order), "_upto": F.sum(F.length("segment").cast("long")).over(order)})
    start = F.col("_upto") - F.length("segment")
    return rows.select("conv_id", "pos", "turn", "segment", (F.col("role") == trainable).alias("is_target"), start.alias("seg_start"),
                       (start + F.col("_head")).alias("loss_start"), (start + F.col("_head") + F.col("_body")).alias("loss_end"))


def examples(segments: DataFrame) -> DataFrame:
    """One row an assistant turn: its context is the first ``context_chars`` of the conversation's text, followed by ``target``, of which [loss_start, loss_end) is trainable."""
    inside = lambda c: (F.col(c) - F.col("seg_start")).alias(c)
    return segments.where("is_target").select("conv_id", F.col("pos").alias("target_pos"), F.col("seg_start").alias("context_chars"), F.col("segment").alias("target"), inside("loss_start"), inside("loss_end"))


def _ordered(segments: DataFrame) -> DataFrame:
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def expanded(segments: DataFrame) -> DataFrame:
    """conv_id, target_pos, text, loss_start, loss_end with every example written out, and, where turns follow the last target, the whole conversation as a row without target; output grows with the square of a conversation's turns, memory does not."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, parts = object(), []

        def row(target: dict | None) -> pa.RecordBatch:
            parts[:] = ["".join(parts)]
            own = target or dict.fromkeys(("pos", "loss_start", "loss_end"))
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "target_pos": own["pos"], "text": parts[0], "loss_start": own["loss_start"], "loss_end": own["loss_end"]}], schema=out)

        closed = True
        for batch in batches:
            for r in batch.to_pylist():
                if r["conv_id"] != conv:
                    if not closed:
                        yield row(None)
                    conv, parts = r["conv_id"], []
                parts.append(r["segment"])
                closed = r["is_target"]
                if closed:
                    yield row(r)
        if not closed:
            yield row(None)

    out = pa.schema([("conv_id", pa.int64()), ("target_pos", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    return _ordered(segments).mapInArrow(expand, "conv_id long, target_pos long, text string, loss_start long, loss_end long")


def example_texts(segments: DataFrame) -> DataFrame:
    """conv_id, target_pos, text, loss_start, loss_end with every example written out."""
    return expanded(segments).where("target_pos IS NOT NULL")


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, _, text = segment[len(HEAD) : -len(TAIL)].partition("\n")
    return unescape(role.replace(LINE, "\n")), unescape(text)


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "context_chars"]


def read_expanded(written: DataFrame) -> DataFrame:
    """Digest of each conversation from its written examples alone, streamed in order: turns are parsed from the texts, what is trained on from the loss spans.

    Raises if an example doesn't begin with the one before it, or its loss span isn't its last turn's text."""
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in NAMES]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state, before = [], None, ""

        def close() -> None:
            if state:
                done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[] for _ in NAMES]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], NAMES)

        for batch in batches:
            for conv, target, text, a, b in zip(*(batch.column(c) for c in ("conv_id", "target_pos", "text", "loss_start", "loss_end"))):
                conv, text = conv.as_py(), text.as_py()
                if state is None or state[0] != conv:
                    close()
                    state, before = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0], ""
                if not text.startswith(before):
                    raise ValueError("an example's context is not the turns before its target")
                for segment in text[len(before) :].split(TAIL)[:-1]:  # no text or role holds a control string
                    role, said = parse_segment(segment + TAIL)
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                state[5], before = len(text), text
                if target.as_py() is not None:
                    a, b, start = a.as_py(), b.as_py(), text.rindex(HEAD)
                    if (a, b) != (text.index("\n", start) + 1, len(text) - len(TAIL)):
                        raise ValueError("a loss span is not the text of its example's last turn")
                    reply = unescape(text[a:b])
                    state[3] += len(reply)
                    state[4].update(reply.encode())
                    state[6] += 1
                    state[7] += start
            yield flush()
        close()
        yield flush()

    rows = written.repartition("conv_id").sortWithinPartitions("conv_id", F.col("target_pos").asc_nulls_last())
    return rows.mapInArrow(digest, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(NAMES, kinds)))


def read_back(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Digest of each conversation from its formatted turns and its examples (``found``) alone, streamed in order: turns come from segments, trainable text from examples.

    Raises if an example's context doesn't end where its target's segment starts."""

    names = NAMES
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state = [], None

        def close() -> None:
            if state:
                done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[] for _ in names]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for conv, kind, text, context, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "text", "context", "a", "b"))):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                if kind == 1:  # a turn
                    role, said = parse_segment(text)
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                    state[5] += len(text)
                else:  # an example comes before its target's turn
                    if context != state[5]:
                        raise ValueError("an example's context is not the turns before its target")
                    reply = unescape(text[a:b])
                    state[3] += len(reply)
                    state[4].update(reply.encode())
                    state[6] += 1
                    state[7] += context
            yield flush()
        close()
        yield flush()

    turns = segments.select("conv_id", "pos", F.lit(1).alias("kind"), F.col("segment").alias("text"), *(F.lit(0).cast("long").alias(c) for c in ("context", "a", "b")))
    own = found.select("conv_id", F.col("target_pos").alias("pos"), F.lit(0).alias("kind"), F.col("target").alias("text"), F.col("context_chars").alias("context"), F.col("loss_start").alias("a"), F.col("loss_end").alias("b"))
    rows = turns.union(own).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    return rows.mapInArrow(digest, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds)))
