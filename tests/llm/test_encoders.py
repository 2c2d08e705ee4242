import random
import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftwell.llm.attribution import attribute, section_tokens
from siftwell.llm.bpe import ByteBpe, byte_of_char, encoder
from siftwell.llm.buffers import SliceCache, ragged, text_bytes
from siftwell.llm.packing import pack, walk
from siftwell.llm.unigram import coder, decoded, encoded

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BPE)  # as it is
ODD = ["it's a test 's", "\n's x", "  a  b \n\n c\t\td  ", "", "   ", " ", "×÷ 3²", "日本 語 kanji’s ▁x ▁", " x 'll \x1c y", "<|endoftext|> a", "a\r\n b", "…—é É ñ", "1 2  33 \n", "a" * 500, "🤦🏼‍♂️ ok"]


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß3-' \n.") for _ in range(rng.randrange(1, 9)))
    return ODD + [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(60)]


def test_bpe_equals_library():
    library = Tokenizer.from_file(BPE)  # as it is
    for plain in (False, True):
        library.encode_special_tokens = plain
        e = encoder(BPE, plain)
        ids, counts = e.encode(*text_bytes(pa.array(texts())))
        for t, own in zip(texts(), np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == library.encode(t, add_special_tokens=False).ids
        assert (50256 in ids) != plain


def test_long_words(spark):
    """A million bytes without a space, and more distinct words than the table holds, in time in proportion to them."""
    rng = np.random.default_rng(6)
    odd = "".join(rng.choice(list("abcdefghij.é日"), 700_000))
    many = " ".join(f"{i:x}" for i in range(620_000))
    u = coder(PIECES)
    texts = [odd, many, "a" * 300_000, odd[:3000]]
    data, offsets = text_bytes(pa.array(texts))
    began = time.time()
    ids, counts = u.encode(data, offsets)
    assert time.time() - began < 60
    bounds = np.concatenate(([0], np.cumsum(counts)))
    raw, places = u.decode(ids, bounds)
    assert raw.tobytes() == data.tobytes() and places.tolist() == offsets.tolist()
    assert ids[bounds[3] :].tolist() == best_path(u, odd[:3000])
    empty = spark.createDataFrame([], "doc_id long, text string, pieces string")
    assert encoded(empty, PIECES).count() == 0


def test_more_distinct_pretokens_than_the_table_holds():
    text = " ".join(f"{i:x}q" for i in range(600_000))
    e = ByteBpe(BPE)
    ids, counts = e.encode(*text_bytes(pa.array([text, "a b", text[:100]])))
    plain = e.plain.encode_to_numpy(text, disallowed_special=())
    assert counts[0] == len(plain) and (ids[: counts[0]] == plain).all()


def test_slice_cache_collisions():
    c = SliceCache(6)
    h = np.arange(1, 30, dtype=np.uint64) << np.uint64(1)
    c.add(h, np.ones(29, np.int32), np.arange(29, dtype=np.int32))
    assert c.values(c.find(h))[1].tolist() == list(range(29)) and (c.find(h + np.uint64(1)) == -1).all()
    assert ragged(np.array([5, 9, 0]), np.array([2, 0, 3])).tolist() == [5, 6, 0, 1, 2]


def test_attribution_rules():
    tokens, sections = np.array([0, 2, 7, 8, 12]), np.array([0, 4, 8, 9, 12])
    assert attribute(tokens[:-1], tokens[1:], sections, "first").tolist() == [2, 1, 1, 0]
    assert attribute(tokens[:-1], tokens[1:], sections, "majority").tolist() == [1, 2, 0, 1]  # 2-7: 2 and 3 characters; 8-12: 1 and 3
    assert attribute(np.array([0]), np.array([4]), np.array([0, 2, 4]), "majority").tolist() == [1, 0]  # a tie goes to the earlier


def sections_of(fields, rule):
    """(field, section, start, characters, tokens, split) by loops over tokens and characters."""
    text = "\n".join(fields)
    of = byte_of_char()
    spans, at = [], 0
    owner = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of each byte
    for i in LIBRARY.encode(text, add_special_tokens=False).ids:
        n = len(LIBRARY.id_to_token(i).encode() if i == 50256 else bytes(of[c] for c in LIBRARY.id_to_token(i)))
        spans.append((owner[at], owner[at + n - 1] + 1, at))
        at += n
    starts = {0: 0}
    for i, c in enumerate(text):
        starts[i] = len(text[:i].encode())
    out, place = [], 0
    for f, t in enumerate(fields):
        t += "\n" * (f + 1 < len(fields))
        lines = [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] or not t else [])
        begin = place
        for k, line in enumerate(lines):
            out.append([f, k, place - begin, len(line), 0, int(0 < place and len(line) > 0 and starts[place] not in {b for _, _, b in spans}), place])
            place += len(line)
    for a, b, _ in spans:
        held = [len(range(max(a, s[6]), min(b, s[6] + s[3]))) for s in out]
        out[held.index(max(held)) if rule == "majority" else next(i for i, h in enumerate(held) if h)][4] += 1
    return [tuple(s[:6]) for s in out]


@pytest.mark.parametrize("rule", ["majority", "first"])
def test_section_tokens_equal_brute_force(spark, rule):
    rows = [(i, t, f"title {i}\n\n" if i % 3 else None, "x") for i, t in enumerate([*texts(), "é\n\n\n\n\nb", "\n\n\n", "🤦\n🤦🏼", "a b\n" * 3000])] + [(900, None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, section string")
    for fields in (["text"], ["title", "text"], ["text", "title"]):
        got = {}
        for r in section_tokens(docs, BPE, rule, fields).collect():
            got.setdefault(r.doc_id, []).append((fields.index(r.field), *r[2:]))
        for i, text, title, _ in rows:
            own = [({"text": text, "title": title}[f] or "") for f in fields]
            if len(own[0]) < 10_000:
                assert sorted(got[i]) == sections_of(own, rule), (own, fields)
            else:
                assert sum(x[4] for x in got[i]) == len(LIBRARY.encode("\n".join(own), add_special_tokens=False).ids)


def test_section_tokens_cases(spark):
    docs = spark.createDataFrame([(None, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.section, r.n_chars) for r in section_tokens(docs, BPE).collect())
    assert got == [("1", 0, 2), ("1", 0, 2), ("1", 1, 1), ("1", 1, 1), ("2", 0, 0), ("None", 0, 2), ("None", 1, 1)]
    assert section_tokens(docs.limit(0), BPE).count() == 0
    with pytest.raises(ValueError):
        section_tokens(docs, BPE, "none")


def best_path(u, text):
    if not text:
        return []
    known = {u.text[i]: (i, s) for i, s in zip(u.ids.tolist(), u.scores.tolist())}
    raw = (" " + text).encode()
    best, back = [0.0] + [-1e300] * len(raw), [None] * (len(raw) + 1)
    for i in range(len(raw)):
        if best[i] < -1e299:
            continue
        char = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        alone = False
        for k in range(1, min(u.longest, len(raw) - i) + 1):
            if piece := known.get(raw[i : i + k]):
                alone |= k == char
                if best[i] + piece[1] > best[i + k]:
                    best[i + k], back[i + k] = best[i] + piece[1], (i, [piece[0]])
        if not alone and best[i] + u.unknown > best[i + char]:
            best[i + char], back[i + char] = best[i] + u.unknown, (i, [int(u.bytes_at[b]) for b in raw[i : i + char]])
    out, i = [], len(raw)
    while i:
        i, ids = back[i]
        out[:0] = ids
    return out


def test_unigram_viterbi_and_round_trip(spark):
    u = coder(PIECES)
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None)]
    out = encoded(spark.createDataFrame(rows, "doc_id long, text string"), PIECES)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        assert got[i].pieces == best_path(u, t or "") and got[i].round_trip
    back = {r.doc_id: r.text for r in decoded(out, PIECES).collect()}
    assert all(back[i] == (t or "") for i, t in rows)


def test_unigram_of_more_words_than_the_table_holds():
    u, few = coder(PIECES), type(coder(PIECES))(PIECES)
    few.cache = SliceCache(4)
    data, offsets = text_bytes(pa.array(["", " ".join(f"w{i} again" for i in range(300)), "a few words again", " ".join(map(str, range(99)))]))
    want, got = u.encode(data, offsets), few.encode(data, offsets)
    assert all(np.array_equal(a, b) for a, b in zip(want, got)) and got[1][0] == 0


def test_packing_tiles_every_document(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (None, "x y"), (907, "again " * 3000), (907, "again " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(docs, BPE, 256).collect()
    import zlib
    from collections import defaultdict

    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    assert sum(r.length for r in got) == sum(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    short = 0
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
        short += at < 256
    assert short <= 1
    for i, t in rows:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
    assert pack(docs.limit(0), BPE).count() == 0


def test_walk_starts_low_and_follows_neighbours():
    s = np.array([[1, 7], [1, 8], [2, 8], [3, 9]], np.int64)
    assert walk(s).tolist() == [3, 0, 1, 2]


def test_packing_keeps_links_of_every_hash_in_many_blocks(spark):
    from siftwell.llm import packing

    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = [f"{rng.randrange(10**9)}" for _ in range(40)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:24] + [f"{rng.randrange(10**9)}" for _ in range(16)]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = {r.doc_id: [r.s0, r.s1, r.s2, r.s3] for r in packing.encoded(docs, BPE, 1).collect()}
    shared = [(a, b) for a in sketches for b in sketches if a < b and any(x == y for x, y in zip(sketches[a], sketches[b]))]
    other = [(a, b) for a, b in shared if sketches[a][0] != sketches[b][0]]
    degree = {d: sum(d in p for p in shared) for p in shared for d in p}
    alone = [(a, b) for a, b in other if degree[a] == degree[b] == 1]
    assert len(alone) >= 5
    for block_rows in (20_000, 5):
        order = {}
        for r in sorted(pack(docs, BPE, 256, block_rows=block_rows).collect(), key=lambda r: (r.sequence_id, r.offset)):
            order.setdefault(r.doc_id, len(order))
        assert all(abs(order[a] - order[b]) == 1 for a, b in alone)
