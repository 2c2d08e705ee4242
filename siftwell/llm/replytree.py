"""Chat formatting from reply trees.

Messages (tree, id, parent, role, text, score) form trees. Self-joins that double their reach give every message its
2**k-th ancestor, its depth and the sum of scores above it, in as many rounds as the depth has bits. Leaves are ranked
within their tree by the mean score of their branch (ties: smaller id), and for the ``best`` of them the same joins,
from the longest reach down, enumerate the path to the root. Each path is one conversation.

The template is ``### role:`` and a line end, the text, a line end, ``</turn>`` and a line end. In texts and roles a
backslash, ``<`` and ``#`` become ``\\\\``, ``\\l`` and ``\\h``, in roles also ``:`` and the line end ``\\c`` and ``\\n``: no
control string can stand inside a text, and reading back is exact. The loss mask covers assistants' texts.

A formatted conversation is kept as one row per turn with its place, so none has to fit in a row; digests read it back
as a stream in order, in constant memory, one task per conversation because SHA-256 runs through it.

Cases: null text and role count as empty; a null tree is a tree of its own; a parent that isn't in the tree makes a
root; messages that lead into a circle have no root and are in no path; of rows with the same tree and id the least
(parent, role, text, score) stays; null scores count as 0.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import cut, ship, stored

OPEN, ROLE_END, CLOSE = "### ", ":\n", "\n</turn>\n"
BACK = {"l": "<", "h": "#", "c": ":", "n": "\n", "\\": "\\"}


def escaped(text: Column, role: bool = False) -> Column:
    for what, by in [("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), *([(":", "\\c"), ("\n", "\\n")] if role else [])]:
        text = F.replace(text, F.lit(what), F.lit(by))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text) if "\\" in text else text


def chain(turns: DataFrame, tree: str, turn: str, block: int = 1024) -> DataFrame:
    """Rows of linear conversations as messages: each replies to the one before it by (turn, role, md5 of text).

    Places are counted in blocks of turns and the blocks' sizes added up, so a long conversation isn't one window.
    """
    t = turns.select(F.struct(F.col(tree)).alias("tree"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    sizes = t.groupBy("tree", "block").agg(F.count("*").alias("n"))
    before = sizes.select("tree", "block", (F.sum("n").over(Window.partitionBy("tree").orderBy("block")) - F.col("n")).alias("before"))
    t = t.withColumn("nth", F.row_number().over(Window.partitionBy("tree", "block").orderBy(F.asc_nulls_first("turn"), "role", F.md5("text"))))
    t = t.join(before, ["tree", "block"]).withColumn("id", F.col("before") + F.col("nth") - 1)
    return t.select("tree", "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, best: int = 4) -> DataFrame:
    """(tree, leaf, branch: rank from 1, branch_score, place: from 0 at the root, id) of the best branches of each tree."""
    m = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = m.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    # reach: the ancestor that many messages up; n and total: of the messages from here to below it
    reach = cut(m.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total")))
    parents = reach.filter("up is not null").select("tree", F.col("up").alias("id")).distinct()
    levels, size = [], reach.count()
    while not (live := reach.filter("up is not null").select("tree", "id", "up")).isEmpty() and 1 << len(levels) <= size:
        levels.append(live)
        above = reach.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        joined = reach.join(above, ["tree", "up"], "left")
        reach = cut(joined.select("tree", "id", F.col("up2").alias("up"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total")))
    rooted = reach.filter("up is null")
    leaves = rooted.join(parents, ["tree", "id"], "left_anti").withColumn("branch_score", F.col("total") / F.col("n"))
    leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "id"))).filter(F.col("branch") <= best)
    path = leaves.select("tree", F.col("id").alias("leaf"), F.col("branch").cast("long").alias("branch"), "branch_score", "n", "id", F.lit(0).cast("long").alias("off"))
    for k, level in reversed(list(enumerate(levels))):
        far = path.join(level, ["tree", "id"]).select("tree", "leaf", "branch", "branch_score", "n", F.col("up").alias("id"), (F.col("off") + (1 << k)).alias("off"))
        path = cut(path.unionByName(far))
    return path.select("tree", "leaf", "branch", "branch_score", (F.col("n") - 1 - F.col("off")).alias("place"), "id")


def formatted(messages: DataFrame, best: int = 4) -> DataFrame:
    """(tree, leaf, branch, branch_score, place, piece, loss_start, loss_length) of every turn of the best branches.

    ``piece`` is the turn as the template has it; the loss mask covers loss_length characters from loss_start.
    """
    m = messages.groupBy("tree", "id").agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")).alias("m")).select("tree", "id", "m.*")
    m = stored(m)  # each round of joins starts from it
    turn = paths(m.select("tree", "id", "parent", "score"), best).join(m.select("tree", "id", "role", "text"), ["tree", "id"])
    head, body = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit(ROLE_END)), escaped(F.col("text"))
    return turn.select(
        "tree", "leaf", "branch", "branch_score", "place", F.concat(head, body, F.lit(CLOSE)).alias("piece"), F.length(head).cast("long").alias("loss_start"),
        F.when(F.col("role") == "assistant", F.length(body)).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, text = piece[len(OPEN) : -len(CLOSE)].split(ROLE_END, 1)
    return unescaped(role), unescaped(text)


def digests(turns: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of conversations, read back from their pieces."""
    ship(turns.sparkSession)
    names = ["tree", "leaf"]
    ordered = turns.select("tree", "leaf", "place", "piece", "loss_start", "loss_length").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, done = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*[(*k, n, a.hexdigest(), loss, b.hexdigest(), chars) for k, n, a, loss, b, chars in done]))
            arrays = [pa.array(columns[0], kinds[0]), pa.array(columns[1], kinds[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3]), pa.array(columns[4], pa.int64()), pa.array(columns[5]), pa.array(columns[6], pa.int64())]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kinds, state = None, None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names]
            for tree, leaf, piece, start, length in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "piece", "loss_start", "loss_length"))):
                if state is None or key != (tree, leaf):
                    if state is not None:
                        done.append((key, *state))
                    key, state = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(piece)
                loss = unescaped(piece[start : start + length])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(piece)
            if done:
                yield flush()
        if state is not None:
            done.append((key, *state))
            yield flush()

    tree, leaf = (ordered.schema[c].dataType.simpleString() for c in names)
    return ordered.mapInArrow(run, f"tree {tree}, leaf {leaf}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
