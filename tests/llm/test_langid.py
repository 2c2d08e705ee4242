import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.llm.buffers import text_bytes
from siftwell.llm.langid import CLASSES, CrossParser, keep_identified, labelled_text, predict, suffix_automaton
from siftwell.llm.queries import op1_cross_parsing

SF = "/root/testdata/sf0.01"


def phrases(train: bytes, text: bytes) -> int:
    """Greedy longest matches by substring search."""
    fold = lambda b: bytes(CLASSES[np.frombuffer(b, np.uint8)].tolist())
    train, text, n, i = fold(train), fold(text), 0, 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in train:
            k += 1
        n, i = n + 1, i + max(1, k)
    return n


def test_automaton_accepts_substrings_alone():
    moves = suffix_automaton(b"abcbc")
    words = {b"abcbc"[i:j] for i in range(5) for j in range(i + 1, 6)}

    def accepts(w):
        s = 0
        for c in w:
            if c not in moves[s]:
                return False
            s = moves[s][c]
        return True

    assert all(map(accepts, words)) and not any(map(accepts, (b"cc", b"ba", b"abcc")))


def test_phrase_counts_equal_brute_force():
    train = {"x": b"the cat sat on the mat", "y": "le chat était là".encode()}
    texts = ["The mat sat", "chat la", "", "zzz the", "é" * 40, "cat 12 on-the"]
    m = CrossParser(train)
    got = m.costs(*text_bytes(pa.array(texts))) / np.array(m.weights)
    for t, row in zip(texts, got):
        assert row.tolist() == [phrases(train[k], t.encode()) for k in ("x", "y")], t


def test_whole_texts_equal_brute_force():
    """Texts of many stretches, some of short period, whose walks from the root never meet the real ones."""
    rng = np.random.default_rng(5)
    words = ["the", "cat", "sat", "on", "a", "mat", "là", "été"]
    train = {"x": " ".join(rng.choice(words, 300)).encode(), "y": b"a" * 37 + b" ab" * 11}
    texts = [" ".join(rng.choice(words, n)) for n in (60, 400, 900)] + ["a" * 5000, "ab" * 1500 + "c", " ab" * 700, "zq" * 600, "b" * 256, "a" * 257, ""]
    m = CrossParser(train)
    got = np.round(m.costs(*text_bytes(pa.array(texts))) / np.array(m.weights), 6)
    for t, row in zip(texts, got):
        assert row.tolist() == [phrases(train[k], t.encode()) for k in ("x", "y")], t[:20]


def test_training_takes_whole_rows(spark):
    rows = [(i, f"word{i} " * 20, "en") for i in range(40)] + [(90, "long " * 2000, "en"), (91, "seul " * 9000, "fr"), (None, "sans numéro", "de"), (None, "sans numéro", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = dict(labelled_text(docs, F.lit(True), train_bytes=2000))
    assert len(texts["en"]) <= 2001 and set(texts["en"].decode().split("\n")) - {""} <= {t for _, t, _ in rows[:40]}
    assert texts["fr"] == ("seul " * 400).encode() + b"\n" and texts["de"] == "sans numéro\n".encode()


def test_held_out_accuracy(spark):
    out = op1_cross_parsing(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.filter("held_out").join(docs, "doc_id")
    right, n = held.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 150 and right / n > 0.97
    assert out.count() == docs.count() and out.filter("score < 0 or score > 1").isEmpty()


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "a"), (2, "le chat et le chien", "fr", "b"), (3, None, "en", "c"), (4, "12 !!", None, "d"), (5, "", "en", "e"), (None, "the dog", None, "f"), (1, "the cat and the dog", "en", "a"), (6, "the cat " * 9000, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    texts = labelled_text(docs, F.lit(True))
    assert [lang for lang, _ in texts] == ["en", "fr"]
    got = [(r["row"].doc_id, r.lang_pred, r["row"].lang_pred) for r in predict(docs, texts).collect()]
    assert got == [(1, "en", "a"), (2, "fr", "b"), (3, "und", "c"), (4, "und", "d"), (5, "und", "e"), (None, "en", "f"), (1, "en", "a"), (6, "en", "g")]
    assert sorted(str(r.doc_id) for r in keep_identified(docs).collect()) == ["1", "1", "2", "6", "None"]
    assert predict(docs.limit(0), ()).count() == 0
