"""Reply trees to training conversations.

Messages name their parent.  Root-to-leaf paths come from self-joins by pointer doubling: after round j
every message knows its ancestor 2**j steps up with the score on the way, so a tree of depth d takes
log2(d) joins over ids and numbers, never over texts.  Leaves are ranked by the score of their path; the
chosen ones walk back over the same tables, largest step first, which meets every ancestor exactly once.

A path becomes one string.  ``<|im_start|>role\\n`` and ``<|im_end|>\\n`` surround each text; inside texts
and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so control strings cannot occur in them and
``read_back`` gives the exact texts again.  The loss mask is a list of [start, end) in code points that
holds the text of each assistant turn and nothing else.  One conversation is one string and so is made
in one task; that is the size of the result itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.session import stage

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
#: An escape is a backslash and the sign it stands for; in roles n stands for a line feed.
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string of (role, text) turns and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def read_back(formatted: str, mask: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns of a formatted string, and the text under its mask."""
    turns = [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]
    return turns, "".join(unescape(formatted[a:b]) for a, b in mask)


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def threads(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as trees without branches: each row replies to the row before it.

    Rows go by turn (null last), then role, then text; repeated rows are turns of their own.
    """
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = messages.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` root-to-leaf paths of each conversation: conv_id, path (1 is best), depth (0 at the leaf), role, text.

    ``messages`` has conv_id, node, parent, role, text and score.  The path with the largest sum of scores
    comes first, then the longer one, then the smaller leaf.  Null scores count 0.  A parent that is
    missing makes its child a root; messages without a root (on a circle or below one) are on no path.
    A repeated node is one node (the smallest row).
    """
    rows = messages.select(
        _key(F.col("conv_id")).alias("conv"), _key(F.col("node")).alias("node"),
        F.when(F.col("parent").isNotNull(), _key(F.col("parent"))).alias("up"),
        F.struct(F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.col("conv_id"), F.col("node").alias("id"), "role", "text").alias("row"),
    )
    rows = rows.groupBy("conv", "node").agg(F.min(F.struct("up", "row")).alias("m")).select("conv", "node", "m.up", "m.row.*")
    rows = stage(rows, "chat_rows")
    known = rows.select("conv", F.col("node").alias("up"), F.lit(True).alias("there"))
    tree = rows.select("conv", "node", "up", "id", "score").join(known, ["conv", "up"], "left").select(
        "conv", "node", F.when(F.col("there"), F.col("up")).alias("up"), "id", F.col("score").alias("total"), F.lit(1).cast("long").alias("length")
    )
    jumps, replies = [stage(tree, "chat_step")], 0
    while True:
        step = jumps[-1]
        open_ = step.filter("up IS NOT NULL").count()
        # a circle never closes; no path has more steps than there are replies
        replies = open_ if len(jumps) == 1 else replies
        if not open_ or (1 << (len(jumps) - 1)) > replies + 1:
            break
        above = step.select("conv", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("length").alias("further"))
        # messages that have reached their root are done; only the others meet their ancestors
        further = step.filter("up IS NOT NULL").join(above, ["conv", "up"]).select(
            "conv", "node", F.col("next").alias("up"), "id", (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("further")).alias("length"),
        )
        jumps.append(stage(step.filter("up IS NULL").unionByName(further), "chat_step"))
    replied = jumps[0].filter("up IS NOT NULL").select("conv", F.col("up").alias("node")).distinct()
    leaves = jumps[-1].filter("up IS NULL").join(replied, ["conv", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("conv").orderBy(F.desc("total"), F.desc("length"), "id"))
    marked = leaves.withColumn("path", rank).filter(F.col("path") <= best).select("conv", "path", "node", F.lit(0).cast("long").alias("depth"))
    for j in range(len(jumps) - 1, -1, -1):
        hop = jumps[j].filter("up IS NOT NULL").select("conv", "node", "up")
        higher = marked.join(hop, ["conv", "node"]).select("conv", "path", F.col("up").alias("node"), (F.col("depth") + (1 << j)).alias("depth"))
        marked = stage(marked.unionByName(higher), "chat_path")
    return marked.join(rows, ["conv", "node"]).select("conv", "conv_id", "path", "depth", "role", "text")


def formatted(messages: DataFrame, best: int = 1) -> DataFrame:
    """conv_id, path, formatted and mask (array of start, end) of the chosen paths; null roles and texts are empty."""
    chosen = paths(messages, best)
    kind = chosen.schema["conv_id"].dataType.simpleString()
    turn = F.struct((-F.col("depth")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = chosen.groupBy("conv", "path").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            mask = pa.array([[{"start": a, "end": b} for a, b in m] for _, m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("path"), pa.array([s for s, _ in made], pa.string()), mask], ["conv_id", "path", "formatted", "mask"])

    return grouped.select("conv_id", "path", "turns").mapInArrow(
        write, f"conv_id {kind}, path int, formatted string, mask array<struct<start:bigint,end:bigint>>")


def digest(output: DataFrame) -> DataFrame:
    """What the formatted strings and masks say when read back."""
    kind = output.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()):
                turns, loss = read_back(text, [(m["start"], m["end"]) for m in mask])
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["conv_id", *names])

    return output.select("conv_id", "formatted", "mask").mapInArrow(
        read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
