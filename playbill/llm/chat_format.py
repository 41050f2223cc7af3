"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, and only its own text is trainable. A conversation is formatted
once, as one segment for each turn; ``with_examples`` writes every example out from its segments, context included, so the output takes
the square of a conversation's length while a task holds the text of one conversation.

A turn is ``<|im_start|>role, newline, text, <|im_end|>, newline``. Inside roles and texts, one backslash goes between the ``<`` and
the ``|`` of every ``<|``, behind any backslashes that are there already, so no control string can occur and taking one backslash out
again restores the text. Roles also have their backslashes and newlines escaped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.arrow import SLICE

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SEGMENTS = "conv_id long, turn long, position long, role string, segment string, start long, end long, loss_start long, loss_end long"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    """Take the added backslash out of every ``<\\|``."""
    if "\\|" not in text:
        return text
    out, at = [], 0
    while (bar := text.find("\\|", at)) >= 0:
        low = bar
        while low > at and text[low - 1] == "\\":
            low -= 1
        keep = bar if low and low > at and text[low - 1] == "<" else bar + 1
        out.append(text[at:keep] + "|")
        at = bar + 2
    return "".join([*out, text[at:]])


def unescape_role(role: str) -> str:
    parts = role.split("\\\\")
    return unescape("\\".join(p.replace("\\n", "\n") for p in parts))


def format_turns(conversations: DataFrame) -> DataFrame:
    """Segments of all conversations with their places: one row for each turn, those of a conversation together and in order.

    ``start`` and ``end`` are code points in the conversation's formatted text. For an assistant turn, the example is the text from 0
    to ``end``, and ``loss_start`` to ``loss_end`` is its target; for others both are null. Turns are ordered by ``turn``, equal ones by
    role and text; a repeated row is a turn of its own. A null role or text is empty, null turns come first, rows without a
    conversation id form one conversation with a null id, and an empty table has no segments. Other columns are not looked at. A
    conversation is written in one pass that holds only a batch of rows, whatever its length.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    placed = turns.withColumns({"head": F.length(head), "segment": F.concat(head, escape(F.col("text")), F.lit(CLOSE))})
    placed = placed.withColumn("size", F.length("segment"))
    ordered = placed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, position = (), 0, 0
        for batch in batches:
            rows = batch.to_pydict()
            places = []
            for conv, role, head, size in zip(rows["conv_id"], rows["role"], rows["head"], rows["size"]):
                if (conv,) != last:
                    last, at, position = (conv,), 0, 0
                target = role == "assistant"
                places.append((position, at, at + size, at + head if target else None, at + size - len(CLOSE) if target else None))
                at, position = at + size, position + 1
            position_, start, end, loss_start, loss_end = (pa.array(c, pa.int64()) for c in (zip(*places) if places else [[]] * 5))
            by = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_arrays(
                [by["conv_id"], by["turn"], position_, by["role"], by["segment"], start, end, loss_start, loss_end],
                ["conv_id", "turn", "position", "role", "segment", "start", "end", "loss_start", "loss_end"],
            )

    return ordered.mapInArrow(run, SEGMENTS)


def with_examples(segments: DataFrame) -> DataFrame:
    """Turns and examples as rows: every turn, with its ``segment``, and behind every assistant turn the ``example`` that it ends.

    An example is a row of its own with its whole ``text``: the conversation's text before the turn (the first ``context_chars``), then the turn, up to
    ``chars``. ``loss_start`` to ``loss_end`` is the range of its target, ``target_text`` the target. A turn has no example and an example no segment. Rows
    keep the order of ``segments``, which must be that of ``format_turns``: a conversation in pieces fails. A task holds the text of one
    conversation and gives rows away in batches of about a megabyte.
    """

    kind = pa.struct([("target", pa.int64()), ("context_chars", pa.int64()), ("chars", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
                      ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.string()), ("example", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text, out, size = (), "", [], 0
        for batch in batches:
            rows = batch.to_pydict()
            for conv, segment, *place in zip(*(rows[c] for c in ("conv_id", "segment", "position", "start", "end", "loss_start", "loss_end"))):
                position, start, end, loss_start, loss_end = place
                if (conv,) != last:
                    last, text = (conv,), ""
                if start != len(text):
                    raise ValueError("the turns of a conversation are not together and in order")
                text += segment
                out.append({"conv_id": conv, "segment": segment, "example": None})
                size += len(segment)
                if loss_start is not None:
                    example = {"target": position, "context_chars": start, "chars": end, "loss_start": loss_start, "loss_end": loss_end, "text": text}
                    out.append({"conv_id": conv, "segment": None, "example": example})
                    size += len(text)
                if size >= SLICE:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    made = segments.select("conv_id", "segment", "position", "start", "end", "loss_start", "loss_end").mapInArrow(
        run, "conv_id long, segment string, example struct<target: long, context_chars: long, chars: long, loss_start: long, loss_end: long, text: string>"
    )
    target = F.substr("example.text", F.col("example.loss_start") + 1, F.col("example.loss_end") - F.col("example.loss_start"))
    return made.withColumn("example", F.when(F.col("example").isNotNull(), F.col("example").withField("target_text", target)))


def expand(segments: DataFrame) -> DataFrame:
    """One example for each assistant turn: its whole text, the lengths of its context and of itself, and the range and text of its target.

    A conversation without an assistant has none, and an empty table gives an empty table; an empty reply is an example with an empty target.
    The output grows with the square of a conversation's length, as written-out prefixes must.
    """
    return with_examples(segments).filter("example is not null").select("conv_id", "example.*")


def render(segments: DataFrame) -> DataFrame:
    """Examples with their texts and loss ranges alone."""
    return expand(segments).select("conv_id", "target", "chars", "loss_start", "loss_end", "text")


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read from the segments as ``format_turns`` lays them out and from the texts of their examples.

    Roles and texts of turns are taken from the formatted turns, targets from the examples' texts under the loss mask. The text of an example must be
    all turns read so far, otherwise reading fails. ``formatted_chars`` is the length of the texts of all examples, context included. A task holds
    the text of one conversation; hashes run on from batch to batch.
    """

    def done(state: dict) -> dict:
        return {
            "conv_id": state["conv"], "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["chars"],
            "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["total"],
        }

    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for conv, segment, example in zip(*(rows[c] for c in ("conv_id", "segment", "example"))):
                if state is None or state["conv"] != conv:
                    if state:
                        out.append(done(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "total": 0, "read": ""}
                if example:
                    text, target = example["text"], example["target_text"]
                    masked = text[example["loss_start"] : example["loss_end"]]
                    if text != state["read"] or target != masked or len(text) - example["loss_end"] != len(CLOSE):
                        raise ValueError("an example is not the text up to its turn")
                    target = unescape(masked)
                    state["loss"].update(target.encode("utf-8", "replace"))
                    state["chars"] += len(target)
                    state["total"] += len(text)
                    continue
                if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
                    raise ValueError("not a formatted turn")
                role, text = segment[len(OPEN) : -len(CLOSE)].split("\n", 1)
                state["n"] += 1
                state["read"] += segment
                state["turns"].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode("utf-8", "replace"))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
        if state:
            yield pa.RecordBatch.from_pylist([done(state)], schema=kind)

    return with_examples(segments).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
