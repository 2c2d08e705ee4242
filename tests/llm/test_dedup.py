import random
from collections import Counter

import numpy as np
import pyarrow as pa

from siftwell.llm.buffers import text_bytes
from siftwell.llm.dartminhash import classes, components, elements, first_of_each, signatures
from siftwell.llm.linefreq import host_of, page_lines, stripped, without_boilerplate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def jaccard(a, b):
    pairs = lambda t: Counter(zip(t.split(), t.split()[1:]))
    a, b = pairs(a), pairs(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_elements_are_weighted_pairs():
    text, h, weight = elements(*text_bytes(pa.array(["a b a b", "", "One", "B, a!", "b one"])))
    assert text.tolist() == [0, 0, 2, 3, 4] and sorted(weight[:2].tolist()) == [1, 2] and weight[2:].tolist() == [1, 1, 1]
    assert h[3] in h[:2] and h[4] not in h[:4]


def test_agreement_estimates_weighted_jaccard():
    rng = random.Random(4)
    base = prose(rng, 300)
    for share in (0.02, 0.1, 0.3):
        other = " ".join(w if rng.random() > share else "zz" for w in base.split())
        sig, has = signatures(*text_bytes(pa.array([base, other, base + " " + base])), 2048)
        assert has.all()
        assert abs((sig[0] == sig[1]).mean() - jaccard(base, other)) < 0.05
        assert abs((sig[0] == sig[2]).mean() - jaccard(base, base + " " + base)) < 0.05


def corpus():
    rng = random.Random(8)
    bases = [prose(rng, 120) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(bases)]
    for i in range(10):
        for k in range(1 + 3 * i):
            words = bases[i].split()
            for _ in range(3):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            rows.append((1000 + 100 * i + k, " ".join(words)))
    return rows + [(2000, bases[20]), (2001, bases[20].upper()), (2002, None), (2003, ""), (2004, "... !!"), (2005, "word"), (2006, "word"), (None, bases[30]), (30, bases[30]), (2007, bases[31] * 50)]


def test_classes(spark):
    rows = corpus()
    got = classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in range(10):
        members = [d for d, _ in rows if d == i or d is not None and 1000 + 100 * i <= d < 1100 + 100 * i]
        assert {by[m].class_id for m in members} == {i} and all(by[m].n_links for m in members)
    assert {by[d].class_id for d in (20, 2000, 2001)} == {20} and by[2006].class_id == by[2005].class_id == 2005
    for d in (*range(11, 20), *range(21, 30), 2002, 2003, 2004, 2007):
        assert by[d].class_id == d and by[d].n_links == 0
    assert sum(r.keep for r in got) == len({(r.class_id if r.n_links else r.rid) for r in got})


def test_first_of_each_keeps_rows_and_columns(spark):
    rows = [(d, t, "en", "s", d) for d, t in corpus()]
    rows += [rows[5], rows[5]]
    got = first_of_each(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "th"))
    ids = Counter(r.doc_id for r in got.collect())
    assert got.columns == ["doc_id", "text", "th", "source", "n_chars"]
    assert ids == Counter({**{i: 1 for i in range(40) if i != 30}, None: 1, 2002: 1, 2003: 1, 2004: 1, 2005: 1, 2007: 1})
    assert first_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_first_of_each_keeps_clashing_columns(spark):
    names = ["row", "id", "th", "gone_id", "gone_th", "twice_id", "is", "_own", "_is", "_twice", "keep", "rid"]
    rows = [(d, t, *[f"{c}{d}" for c in names]) for d, t in [*corpus()[:12], corpus()[5], corpus()[5]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = first_of_each(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(set(rows[:12]))


def test_links_are_all_banded_pairs(spark):
    rng = random.Random(5)
    base = prose(rng, 150).split()
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base) for share in (0.03, 0.08, 0.15) for _ in range(50)]
    sig, _ = signatures(*text_bytes(pa.array(texts)))
    same = sig[:, None] == sig[None]
    linked = (same.mean(axis=2) >= 0.55) & same.reshape(150, 150, 25, 5).all(axis=3).any(axis=2) & ~np.eye(150, dtype=bool)
    want = linked.sum(axis=1).tolist()
    assert max(want) > 90 and min(want) < 60
    rows = list(enumerate(texts)) + [(200, texts[0].upper()), (201, texts[0])]
    twin = [linked[0, i] for i in range(150)]  # the text in capitals is another text of the same signature
    for block in (2048, 7):
        got = {r.doc_id: r.n_links for r in classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
        assert [got[i] for i in range(150)] == [n + int(twin[i]) + 2 * (i == 0) for i, n in enumerate(want)]
        assert got[200] == want[0] + 1 and got[201] == got[0]


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102)]
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_lines_by_site(spark):
    rows = [(i, f"menu\n  own {i}\n\nmenu \t\nfoot" if i % 4 else f"own {i}\nmenu", "en", "a" if i < 40 else "b", 9) for i in range(50)]
    rows += [(100, None, "en", "a", None), (101, "", "en", "a", 0), (102, "menu", "en", None, 4), (103, "menu\nfoot", "en", "a", 9)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "site")
    got = {r.doc_id: r for r in without_boilerplate(df, "source", ratio=0.5).collect()}
    assert got[1].text == "  own 1\n" and got[1].n_chars == 8 and got[0].text == "own 0" and got[45].text == "  own 45\n" and got[45].n_chars == 9
    assert got[100].text is None and got[101].text == "" and got[102].text == "menu" and got[103].text == "" and got[1].site == "en"
    from siftwell.llm import linefreq

    old, linefreq.BROADCAST_BYTES = linefreq.BROADCAST_BYTES, 0
    try:
        again = {r["row"].doc_id: r.kept for r in stripped(df, "source", ratio=0.5).collect()}
    finally:
        linefreq.BROADCAST_BYTES = old
    assert again == {i: r.text for i, r in got.items()}
    assert without_boilerplate(df.limit(0), "source").count() == 0


def test_small_sites_and_repeated_rows(spark):
    rows = [(i, f"top\nown {i}", "en", "small", 9) for i in range(4)] + [(4, "top\nown 1", "en", "two", 9), (5, "top\nown 2", "en", "two", 9)] + [(6, "twin\nx", "en", "rep", 6)] * 3
    df = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.text) for r in without_boilerplate(df, "source", ratio=0.5).collect())
    assert got == Counter({**{(i, f"own {i}"): 1 for i in range(4)}, (4, "top\nown 1"): 1, (5, "top\nown 2"): 1, (6, ""): 3})
    by_ratio = {r.doc_id: r.text for r in without_boilerplate(df, "source", ratio=0.5, least_holders=1).collect()}
    assert by_ratio[4] == "own 1" and by_ratio[5] == "own 2"


def test_page_lines(spark):
    html = "<!DOCTYPE html><HTML lang='x'><p>One <b>two</b><br/>three</P><div class=\"a\">four\nfive</div><pre>six</pre><param>"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(page_lines("h")).collect()
    assert [line for line in got[0][0].split("\n") if line] == ["<!DOCTYPE html>", "One <b>two</b>", "three", "four", "five", "six", "<param>"] and got[1][0] is None


def test_host(spark):
    urls = ["http://A.example.com:80/x?y", "https://u:p@b.org", "nothing", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of("u")).collect()] == ["a.example.com", "b.org", None, None]


def test_runs_of_equal_words_have_signatures():
    sig, has = signatures(*text_bytes(pa.array(["na " * 5000, "na " * 2500, "a"])))
    assert has.all() and abs((sig[0] == sig[1]).mean() - 0.5) < 0.15 and np.abs(sig[2]).sum() > 0
