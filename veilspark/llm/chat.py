"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own,
with all turns before it as context and only that reply under the loss mask.

Template. A turn is ``<s>[INST] role [/INST]text</s>``. In roles and texts a backslash is doubled
and each of the four control strings gets a backslash after its first character, so none of them
can occur inside, and :func:`unescape` gives back the original.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        middle = formatted.index(MIDDLE, at)
        end = formatted.index(CLOSE, middle)
        turns.append((unescape(formatted[at + len(OPEN) : middle]), unescape(formatted[middle + len(MIDDLE) : end])))
        at = end + len(CLOSE)
    return turns


def examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last) from rows (conv_id, turn, role, text).

    One example for each turn of ``target_role``: its text holds all turns up to it, the loss mask
    is the escaped reply, [loss_start, loss_end) in characters. A conversation that doesn't end
    with such a turn gets a last example with all its turns and an empty mask, so that nothing is
    lost. ``last`` marks the example that holds the whole conversation.

    Turns are taken in the order of (turn, role, text), nulls first, so ties and repeated rows keep
    a fixed order. Null roles and texts count as empty; rows with a null conv_id form one
    conversation. Partitions are sorted by Spark and streamed: a task holds one running prefix, as
    long as its longest example, and emits batches of bounded size. Other columns are ignored.
    """
    kind = dict(turns.dtypes)["conv_id"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["conv_id", "example", "text", "loss_start", "loss_end", "last"]

    def run(batches):
        out: list[list] = [[] for _ in names]
        held, current, begun = 0, None, False
        prefix: list[str] = []
        length = number = 0
        pending: tuple | None = None  # the newest example: whether it is the last is known later
        types = None

        def flush():
            nonlocal out, held
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
            out, held = [[] for _ in names], 0
            return batch

        def add(row: tuple, last: bool):
            nonlocal held
            for column, value in zip(out, (*row, last), strict=True):
                column.append(value)
            held += len(row[2])

        def close():
            nonlocal pending
            if begun:
                if pending is not None and len(pending[2]) == length:
                    add(pending, True)
                else:
                    if pending is not None:
                        add(pending, False)
                    add((current, number, "".join(prefix), length, length), True)
            pending = None

        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not begun or conv != current:
                    close()
                    current, begun, prefix, length, number = conv, True, [], 0, 0
                head, body = OPEN + escape(role) + MIDDLE, escape(text)
                prefix.append(head + body + CLOSE)
                start = length + len(head)
                length = start + len(body) + len(CLOSE)
                if role == target_role:
                    if pending is not None:
                        add(pending, False)
                    prefix = ["".join(prefix)]
                    pending = (current, number, prefix[0], start, start + len(body))
                    number += 1
                if held > _BATCH_CHARS:
                    yield flush()
        close()
        if out[0]:
            yield flush()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, example long, text string, loss_start long, loss_end long, last boolean")


def digests(made: DataFrame) -> DataFrame:
    """What the examples hold, read back from their texts and masks, one row per conversation."""
    kind = dict(made.dtypes)["conv_id"]

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, start, end, last in zip(*(batch.column(c).to_pylist() for c in ("text", "loss_start", "loss_end", "last")), strict=True):
                turns = parse(text) if last else None
                said = "".join(f"{role}\n{body}\n" for role, body in turns or ())
                for column, value in zip(out, (len(turns) if last else None, hashlib.sha256(said.encode()).hexdigest() if last else None, unescape(text[start:end]), len(text)), strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.record_batch([batch.column("conv_id"), batch.column("example"), *arrays], ["conv_id", "example", "n", "sha", "loss", "chars"])

    read = made.mapInArrow(run, f"conv_id {kind}, example long, n long, sha string, loss string, chars long")
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    grouped = read.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("_loss"), F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
