import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from siftwell.llm.buffers import text_bytes
from siftwell.llm.dartminhash import signatures
from siftwell.llm.langid import CLASSES, labelled_text

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, names = docs.count(), docs.columns
    sizes = [n]
    for i, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, SF)
        if i < 4:
            docs = C.stored(docs)
            assert docs.columns == names
            sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > 0.97 * n and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] <= sizes[3]
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_lines_of_small_sites(spark):
    menu = [(i, f"menu\nown {i}", "en", "of 19", 9) for i in range(19)]
    both = [(i, f"both\nown {i}", "en", "of 2", 9) for i in (20, 21)]
    docs = spark.createDataFrame(menu + both, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in C.lines(spark, docs, SF).collect()}
    assert got == {**{i: f"own {i}" for i in range(19)}, 20: "both\nown 20", 21: "both\nown 21"}


def phrases(train, text):
    fold = lambda b: bytes(CLASSES[np.frombuffer(b, np.uint8)].tolist())
    train, text, n, i = fold(train), fold(text), 0, 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in train:
            k += 1
        n, i = n + 1, i + max(1, k)
    return n


def by_language(rows, training):
    out = []
    for r in rows:
        data = (r["text"] or "").encode()
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            continue
        costs = [(phrases(t, data) * np.log2(len(t)), np.log2(len(t))) for _, t in training]
        best, weight = min(costs, key=lambda c: c[0])
        if max(0, best - weight) / len(data) <= 8:
            out.append(r)
    return out


def without_lines(rows):
    core = lambda line: line.strip(" \t\r\v\f")
    pages, holders = Counter(), Counter()
    for r in rows:
        if r["text"] is not None and r["source"] is not None:
            pages[r["source"]] += 1
            holders.update({(r["source"], core(x)) for x in r["text"].split("\n") if core(x)})
    gone = {k for k, n in holders.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    out = []
    for r in rows:
        lines = r["text"].split("\n")
        kept = [x for x in lines if (r["source"], core(x)) not in gone]
        out.append(r | ({"text": "\n".join(kept), "n_chars": len("\n".join(kept))} if len(kept) < len(lines) else {}))
    return out


def one_of_each(rows):
    sig, has = signatures(*text_bytes(pa.array([r["text"] for r in rows])))
    same = sig[:, None] == sig[None]
    near = (same.mean(axis=2) >= 0.55) & same.reshape(len(rows), len(rows), 25, 5).all(axis=3).any(axis=2) & has[:, None] & has[None]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in np.flatnonzero(near[i]).tolist() + [i]) for i in range(len(rows))]
    first = {}
    for i, g in enumerate(group):
        key = (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, i)
        first[g] = min(first.get(g, key), key)
    once = {(rows[k[2]]["doc_id"], rows[k[2]]["text"]): rows[k[2]] for k in first.values()}  # rows without a word may repeat
    return list(once.values())


def without_copies(rows, width=50):
    first = {}
    for r in rows:
        data = r["text"].encode()
        for i in range(len(data) - width + 1 if r["doc_id"] is not None else 0):
            s = data[i : i + width]
            first[s] = min(first.get(s, r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        data, gone = r["text"].encode(), set()
        for i in range(len(data) - width + 1 if r["doc_id"] is not None else 0):
            if first[data[i : i + width]] < r["doc_id"]:
                gone.update(range(i, i + width))
        kept, at = "", 0
        for c in r["text"]:
            n = len(c.encode())
            kept += "" if all(k in gone for k in range(at, at + n)) else c
            at += n
        if kept or not gone:
            out.append(r | ({"text": kept, "n_chars": len(kept)} if kept != r["text"] else {}))
    return out


def test_stages_equal_brute_force(spark):
    """All stages on odd rows: null and empty texts, repeated rows, near copies, shared passages, boilerplate, a null doc_id."""
    own = [r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist() if len(r["text"]) < 900][:90]
    passage = " ".join(own[3]["text"].split()[:40]) + " a passage that goes on for some more words than that"
    odd = [
        {"doc_id": 9001, "text": None}, {"doc_id": 9002, "text": ""}, {"doc_id": 9003, "text": "12 34 !!"}, {"doc_id": 9004, "text": "x\u4e2d\u6587" * 9}, own[5], own[5], {"doc_id": 9005, "text": own[7]["text"] + " end"},
        {"doc_id": None, "text": own[9]["text"] + " more"}, {"doc_id": 9006, "text": "Of this one alone: " + passage}, {"doc_id": 9007, "text": passage + " é and so on"}, {"doc_id": 9008, "text": "\u0416\u0437\u044f " * 40},
    ]
    rows = [{"lang": "en", "source": "odd", "n_chars": len(r["text"] or ""), **r} for r in [*own, *odd]]
    rows = [r | {"text": r["text"] + "\nAll rights reserved here."} if r["text"] and r["source"] in ("src1", "src2") else r for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], schema).coalesce(1)
    want, sizes = rows, []
    for step in (lambda x: by_language(x, labelled_text(docs, F.lit(True))), without_lines, one_of_each, without_copies):
        want = step(want)
        sizes.append(len(want))
    assert len(rows) > sizes[0] and sizes[1] > sizes[2]
    got = docs
    for i, (_, stage) in enumerate(C.STAGES[:4]):
        got = C.stored(stage(spark, got, ""))
        assert got.count() == sizes[i], C.STAGES[i]
    key = lambda r: (str(r["doc_id"]), r["text"], r["lang"], r["source"], r["n_chars"])
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(map(key, want))
    library, pieces = Tokenizer.from_file(C.bpe_path()), defaultdict(list)
    packed = C.STAGES[4][1](spark, got, "").collect()
    for r in packed:
        pieces[r.doc_id].append(r)
    for r in want:
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[p.start : p.start + p.length]))
            at += p.length
        assert at == len(ids)
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and sum(n < 2048 for n in filled.values()) <= 1
