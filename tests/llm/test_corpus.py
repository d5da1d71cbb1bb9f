"""Operators that compare documents: lines, windows, near copies, vectors, benchmark passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import arrays, decontaminate, embeddings, lines, minhash, queries, repeats, rindex, substrings
from tests.llm import brute
from tests.tests_support import check

DATA = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string"


def copies(seed, n=40, words=60, alphabet=30):
    """Documents with shared passages, near copies, repeats within one, and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 7))) for _ in range(alphabet)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [make(words // 2) for _ in range(4)]
    docs = {}
    for i in range(n):
        w = make(rng.randint(0, words))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        if i and rng.random() < 0.3 and docs[i - 1]:
            w = docs[rng.randrange(i)].split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs[i] = rng.choice([" ", "  ", "\n"]).join(w)
    docs |= {100: None, 101: "", 102: " \n\t", 103: "a", 104: "ab " * 300, 105: "ab " * 300, 106: "z" * 400, 107: "\U0001f389é" * 90, 108: "\U0001f389é" * 90}
    return docs


def frame(spark, docs, extra=True):
    rows = [(d, t, "k", 1) for d, t in docs.items()] + [(None, "nobody", "k", 1)]
    return spark.createDataFrame(rows, TEXT + ", key string, page int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], TEXT)


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL])
def test_oracles(spark, name):
    check(spark, name, "sf0.001")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_lines(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        _lines(spark)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def _lines(spark):
    long = "This line is long enough to count as one, certainly."
    docs = {1: long, 2: f" {long}\t\nother", 3: long.upper(), 4: f"x\n{long}\n{long}", 5: f"{long}\n", 6: None, 7: "", 8: "\n\n", 9: f"{long}É", 10: "short\n" * 5000, 11: long.lower()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(frame(spark, docs)).collect()}
    assert got == brute.lines(docs)
    assert lines.dedup_lines(empty(spark)).count() == 0
    assert lines.dedup_lines(spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], TEXT)).collect()[0].text == "a"


@pytest.mark.parametrize("seed,times", [(1, 2048), (2, 2), (3, 24)])
def test_word_windows(spark, monkeypatch, seed, times):
    monkeypatch.setattr(repeats, "HOT", times)  # 2: all repeated minimisers are split into windows
    docs = copies(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in substrings.dedup_words(frame(spark, docs)).collect()}
    assert got == brute.word_windows(docs)


@pytest.mark.parametrize("seed,times", [(1, 2048), (2, 2), (3, 24)])
def test_byte_windows(spark, monkeypatch, seed, times):
    monkeypatch.setattr(repeats, "HOT", times)
    docs = copies(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in substrings.dedup_bytes(frame(spark, docs)).collect()}
    assert got == brute.byte_windows(docs)


def test_windows_of_nothing(spark):
    assert substrings.dedup_words(empty(spark)).count() == 0 and substrings.dedup_bytes(empty(spark)).count() == 0


def test_word_windows_of_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(substrings, "window_hashes", lambda v, k: np.arange(len(v) - k + 1, dtype=np.uint64) % np.uint64(5))
    head = np.zeros(2, repeats.ENTRY)
    head["doc"] = [1, 2]
    a, b = b"a b c d e", b"x b c d f"
    got, size = substrings.sorted_windows(head, [a, b], 3)
    assert size.tolist() == [3, 3] and got.tolist() == [False] * 3 + [False, True, False]


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def structured():
    """Different long words on which polynomial hashes modulo a power of two agree."""
    flip = str.maketrans("ab", "ba")
    docs, i = {}, 0
    for n in (1024, 2048, 4096):
        for t in (thue_morse(n), thue_morse(n).translate(flip)):
            docs[i] = " ".join([t, *(f"w{n}x{j}" for j in range(14))])
            docs[i + 100] = t
            i += 1
    return docs


def test_structured_words(spark):
    docs = structured()
    words = [t.split()[0].encode() for t in docs.values()]
    data, starts = arrays.joined(words)
    a, b, _ = arrays.words_in(data, starts)
    assert len(set(arrays.word_hashes(data, a, b).tolist())) == len(set(words)) == 6
    df = frame(spark, docs)
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in substrings.dedup_words(df).collect()} == brute.word_windows(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in substrings.dedup_bytes(df).collect()} == brute.byte_windows(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k=4).collect()} == brute.near(docs, 4)


def test_bytes_in_common():
    rng = random.Random(3)
    x, y = (bytes(rng.choice(b"ab") for _ in range(300)) for _ in range(2))
    at, place, most = (np.array([rng.randrange(m) for _ in range(500)]) for m in (200, 200, 100))
    got = arrays.common_bytes(arrays.eights(x), at, arrays.eights(y), place, most)
    for g, i, j, m in zip(got.tolist(), at.tolist(), place.tolist(), most.tolist()):
        assert g == next((k for k in range(m) if x[i + k] != y[j + k]), m)


def test_many_bytes_in_common():
    x = bytes(range(256)) * 8
    cut = [0, 1, 7, 8, 255, 256, 257, 263, 264, 1000, 2047, 2048]
    for n in cut:
        y = x[:n] + bytes(b ^ 1 for b in x[n:])
        assert arrays.common_bytes(arrays.eights(x), np.zeros(1, np.int64), arrays.eights(y), np.zeros(1, np.int64), np.array([2048])).tolist() == [n]


def test_windows_of_many_bytes(spark):
    words = [f"{'verylongword' * 4}{i}" for i in range(40)]  # 13 of them are over 600 bytes
    docs = {1: " ".join(words), 2: " ".join(words[:30]), 3: " ".join(["x", *words[10:], "y"]), 4: " ".join(words[:13][:-1] + ["other"]), 5: " ".join(words[::-1])}
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in substrings.dedup_words(frame(spark, docs)).collect()} == brute.word_windows(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in substrings.dedup_bytes(frame(spark, docs)).collect()} == brute.byte_windows(docs)


def test_query_windows_on_data(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op8_substring_dedup(spark, DATA).collect()} == brute.word_windows(docs)
    assert {r.doc_id: tuple(r)[1:] for r in queries.op5_suffix_dedup(spark, DATA).collect()} == brute.byte_windows(docs)


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(60):
        k = rng.choice([3, 6])
        some = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
        base = some(30)
        texts = [some(rng.randint(0, 4)) + base[rng.randint(0, 20) :] + some(k + 5) for _ in range(5)]
        data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        raw = data.tobytes()
        assert rindex.suffix_array(data).tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : raw.index(b"\xff", i) + 1], i))
        strings = [some(3) + base[5:20] + some(k) for _ in range(4)] + [b"zzzzzz" + base]
        for s, hit in zip(strings, rindex.long_matches(rindex.RunLengthIndex(data), strings, k)):
            assert hit.tolist() == [any(s[i : i + k] in t for t in texts) for i in range(len(s) - k + 1)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_copies(spark, k):
    docs = copies(7, n=80, words=50, alphabet=200)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, docs), k=k).collect()}
    assert got == brute.near(docs, k)


def test_chains_of_copies(spark):
    """Each links with the next only: components need more than stars."""
    base = [f"w{i}" for i in range(400)]
    docs = {i: " ".join(base[8 * i : 8 * i + 120]) for i in range(30)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, docs), k=4).collect()}
    assert got == brute.near(docs, 4) and len({c for _, c, _ in got.values()}) == 1


def test_near_copies_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    only = minhash.near_duplicates(spark.createDataFrame([(1, None), (2, "a"), (3, "A")], TEXT)).collect()
    assert sorted((r.doc_id, r.component_id) for r in only) == [(1, 1), (2, 2), (3, 2)]


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2)]
    sets.append(np.unique(np.concatenate([sets[0][40:], sets[1][:30]])))
    bits = minhash.parity(sets)
    for i in range(3):
        for j in range(3):
            apart = sum((int(a) ^ int(b)) .bit_count() if (int(a) ^ int(b)) >= 0 else 64 - (~(int(a) ^ int(b))).bit_count() for a, b in zip(bits[i], bits[j]))
            assert apart <= len(np.setxor1d(sets[i], sets[j]))


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = {}
    for i in range(120):
        v = rng.normal(size=12)
        if i % 3 and i > 3:
            v = np.array(rows[i - 3]) * 2.5 + rng.normal(size=12) * rng.choice([0.0, 0.1, 0.25])
        rows[i] = [float(np.float32(x)) for x in v]
    rows |= {200: None, 201: [], 202: [0.0] * 12, 203: [float("nan")] + [1.0] * 11, 204: [float("inf")] * 12, 205: [None] + [1.0] * 11, 206: [1.0, 2.0], 207: [2.0, 4.0], 208: [1e-200] + [0.0] * 11, 209: [1e200] + [0.0] * 11}
    df = spark.createDataFrame([(i, v, 3) for i, v in rows.items()] + [(None, [1.0] * 12, 3)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    want = brute.vectors({i: v for i, v in rows.items() if i < 208})
    assert {i: v for i, v in got.items() if i < 208} == want
    assert got[208] == (1, 208, True) and got[209] == (1, 208, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block,tile", [(16, 4), (64, 8)])
def test_blocks_of_vectors(spark, monkeypatch, block, tile):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", block * 24)
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 6))
    rows = {i: [float(x) for x in centres[i % 8] + rng.normal(size=6) * 0.2] for i in range(200)}
    rows |= {300 + i: rows[0] for i in range(20)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")).collect()}
    assert got == brute.vectors(rows)


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree at night"
    edited = item.replace("night", "dawn")
    docs = {1: f"intro {item} outro", 2: f"intro, {item.upper().replace(' ', ' -- ')}!", 3: edited, 4: "nothing here at all to see", 5: None, 6: "", 7: item[: len(item) // 2], 8: " ".join([item] * 3), 9: "yes no", 10: "say yes  NO now", 11: "x " * 30000}
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "Yes no"), (None, "nothing here at all to see")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 6)) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    n = len(item.split())
    assert {k for k in got if k[1] == 1} == {(1, 1), (2, 1), (3, 1), (8, 1)}
    assert {k for k in got if k[1] == 4} == {(9, 4), (10, 4)} and len(got) == 6
    assert got[1, 1] == (1, n, 1.0) and got[10, 4] == (1, 2, 1.0) and got[3, 1][2] == round((n - 5) / (n - 3), 6)
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.leaks(empty(spark), bench).count() == 0


def test_leaks_over_all_windows(spark):
    """Edits at the edges and inside, repeated shingles, short items, documents shorter than an item."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: make(rng.randint(14, 60)) for i in range(12)} | {20: ["a", "b"], 21: ["solo"], 22: make(4), 23: ["x", "y", "z"] * 8, 24: make(5)}
    docs = {}
    for i in range(160):
        w = make(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            p = list(items[rng.choice(list(items))])
            for _ in range(rng.randint(0, 2)):
                at = rng.choice([0, len(p) - 1, rng.randrange(len(p))])
                p[at : at + rng.randint(0, 1)] = make(rng.randint(0, 2))
                p = p or ["w1"]
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs[i] = rng.choice([" ", ", "]).join(w)
    docs |= {200: " ".join(items[3][2:]), 201: " ".join(items[4][:-3]), 202: "x y z " * 400, 203: " ".join(items[0] * 5)}
    want = brute.leaks(docs, {i: " ".join(w) for i, w in items.items()})
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert len(want) > 100 and set(got) <= set(want)
    assert len(got) >= 0.99 * len(want)  # fingerprints further than the radius are lost
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


def test_fingerprints_of_similar_windows_lie_within_the_radius(spark):
    """Measured recall of the fingerprint index on windows at similarity 0.8, the worst case."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        size = rng.randint(18, 54)
        x = [rng.getrandbits(63) for _ in range(size)]
        apart = int(size * 0.2 / 1.8)
        rows.append((i, x, x[apart:] + [rng.getrandbits(63) for _ in range(apart)]))
    df = spark.createDataFrame(rows, "id long, x array<long>, y array<long>")
    far = df.where(F.bit_count(decontaminate.simhash(F.col("x")).bitwiseXOR(decontaminate.simhash(F.col("y")))) > decontaminate.RADIUS).count()
    assert far <= 0.005 * len(rows)


def test_simhash_blocks_reach_their_radius():
    rng = random.Random(1)
    listed = [set(decontaminate.masks(w, decontaminate.LISTED)) for w in decontaminate.BLOCKS]
    looked = [decontaminate.masks(w, decontaminate.LOOKED) for w in decontaminate.BLOCKS]
    assert sum(decontaminate.BLOCKS) == 64
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)))
        low, met = 0, False
        for i, w in enumerate(decontaminate.BLOCKS):
            own = (x >> low) & (2**w - 1)
            met |= any(own ^ m in listed[i] for m in looked[i])
            low += w
        assert met
