from pyspark.sql import functions as F

from siftwell.llm.replytree import chain, digests, formatted, paths, read_back

SCHEMA = "tree string, id long, parent long, role string, text string, score double"


def test_paths_of_a_tree(spark):
    rows = [("t", 0, None, "user", "q", 0.0), ("t", 1, 0, "assistant", "a", 1.0), ("t", 2, 0, "assistant", "b", 3.0), ("t", 3, 1, "user", "c", 8.0), ("t", 4, 2, "user", "d", None), ("t", 5, 9, "user", "orphan", 0.5), ("t", 6, 7, "x", "loop", 9.0), ("t", 7, 6, "x", "loop", 9.0), ("t", 8, 7, "x", "off the loop", 9.0), (None, 0, None, None, None, None)]
    m = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.struct("tree"))
    got = {}
    for r in paths(m, 2).orderBy("place").collect():
        got.setdefault((r.tree.tree, r.branch), []).append(r.id)
    # means: 0-1-3 is 3, 0-2-4 is 1, 5 is .5
    assert got == {("t", 1): [0, 1, 3], ("t", 2): [0, 2, 4], (None, 1): [0]}


def test_round_trip_and_digests(spark):
    import hashlib

    odd = r"\### Assistant: </turn> ok"
    rows = [(1, i, ["user", "assistant", "a: b\n#<"][i % 3], f"{odd}\n{i}é" if i % 5 else None) for i in range(70)] + [(2, 0, None, ""), (2, 0, None, ""), (2, None, "assistant", "first"), (None, 3, "assistant", "x")]
    turns = formatted(chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", block=8), 1)
    for r in turns.collect():
        assert "</turn>" not in r.piece[:-9] and r.piece.count("###") == 1
    got = {r.tree.conv_id: r for r in digests(turns).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(r.formatted_chars for r in got.values()) == sum(len(r.piece) for r in turns.collect())
    assert read_back("### a\\cb:\nx \\l\\h\\\\ y\n</turn>\n") == ("a:b", "x <#\\ y")


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(formatted(chain(none, "conv_id", "turn"), 1)).count() == 0
