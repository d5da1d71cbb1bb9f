"""Cross-tokenizer alignment, centroid clustering, URL filters, samples: against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import align, centroids, langid, queries, repeats, samples, substrings, toxicity, urls
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- alignment


def aligned_by_hand(texts):
    """The libraries on whole texts, ends by byte, overlaps pair by pair."""
    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    own = {c: b for b, c in align.byte_symbols().items()}
    out, holds = [], Counter()
    for t in texts:
        spans, sides = [], []
        if t:
            x = a_side.encode(f" {t}", add_special_tokens=False)
            y = b_side.encode(t)
            sides = [[(i, bytes(own[c] for c in a_side.id_to_token(i))) for i in x.ids], [(i, bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()) for i in y]]
        if not t or any(b"".join(b for _, b in side) != f" {t}".encode() for side in sides):
            out.append(None)
            continue
        for side in sides:
            at, own_spans = 0, []
            for i, raw in side:
                own_spans.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own_spans)
        common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for i, s, z in side if low <= s and z <= e) for side in spans))
            low = e
        links = [(i, j) for i, s, z in spans[0] for j, u, v in spans[1] if max(s, u) < min(z, v)]
        for p in set(links):
            holds[p] += 1
        out.append((len(spans[0]), len(spans[1]), groups, links))
    most = Counter()
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if o is None else (o[0], o[1], len(o[2]), len(o[3]), sum(holds[p] == most[p[0]] for p in o[3]), sum(holds[p] for p in o[3]), brute.sha(";".join(o[2]))) for o in out]


def odd_texts():
    rng = random.Random(5)
    letters = "abcdeé 日\n\t  -'<|>▁\x00\xa0😀İ.,1"
    return [None, "", " ", "  ", "a  b ", "\n a", "a \n b", "▁", "x ▁ y", "<|endoftext|> <s> </s><unk> <0x41>", "don't  'll\t x", "\x85 \xa0 　 x", "x" * 3000, "word " * 50, " ".join(["same text"] * 9), "same text", "same text"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("chunk", [align.CHUNK, 40])
def test_alignment_equals_whole_texts(spark, chunk):
    """Small chunks change nothing; each row is a document, repeated and missing ids too."""
    texts = odd_texts()
    rows = [(i if i % 7 else None if i % 2 else 3, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(3)
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in align.aligned(df, A, B, chunk=chunk).collect())
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, aligned_by_hand(texts), strict=True))
    assert align.aligned(df.limit(0), A, B).collect() == []


def test_alignment_with_a_small_memo(monkeypatch):
    monkeypatch.setattr(align, "MEMO", 200)
    texts, a = odd_texts(), align.Aligner(A, B)
    for i in range(0, len(texts), 5):
        told, counts, *_ = a.batch(texts[i : i + 5])
        want = aligned_by_hand(texts[i : i + 5])
        assert [brute.sha(g) if g else "" for g in told] == [w[-1] for w in want] and counts.tolist() == [list(w[:4]) for w in want]


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_alignment(spark, DATA).collect()}
    short = [r for r in docs if len(r.text or "") < 4000]
    want = dict(zip([r.doc_id for r in docs], _query_by_hand(docs), strict=True))
    assert {r.doc_id: got[r.doc_id] for r in short} == {r.doc_id: want[r.doc_id] for r in short} and len(got) == len(docs)


def _query_by_hand(docs):
    """As ``aligned_by_hand``, with links by a sweep: texts are long."""
    a = align.Aligner(A, B)
    a_side = a.a
    out, holds = [], Counter()
    for r in docs:
        if not r.text:
            out.append(None)
            continue
        x, y = a_side.encode(f" {r.text}", add_special_tokens=False).ids, a.b.encode(r.text)
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((a.bytes_a, x), (a.bytes_b, y))]
        if any(b"".join(table[i] for i in ids) != f" {r.text}".encode() for table, ids in ((a.bytes_a, x), (a.bytes_b, y))):
            out.append(None)
            continue
        links, groups, i, j, p, q = [], [], 0, 0, 0, 0
        while i < len(x) and j < len(y):
            links.append((x[i], y[j]))
            e, f = ends[0][i], ends[1][j]
            i, j = i + (e <= f), j + (f <= e)
            if e == f:
                groups.append(f"{','.join(map(str, x[p:i]))}|{','.join(map(str, y[q:j]))}")
                p, q = i, j
        for pair in set(links):
            holds[pair] += 1
        out.append((len(x), len(y), groups, links))
    most = Counter()
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if o is None else (o[0], o[1], len(o[2]), len(o[3]), sum(holds[p] == most[p[0]] for p in o[3]), sum(holds[p] for p in o[3]), brute.sha(";".join(o[2]))) for o in out]


def test_groups_as_text(spark):
    df = spark.createDataFrame([("ab cd",), (None,)], "text string")
    rows = align.groups(df, A, B).collect()
    assert "|" in rows[0].groups and rows[1].groups == ""
    with pytest.raises(ValueError):
        align.groups(df, A, B, into="text")


# ---------------------------------------------------------------- clusters


def clusters_by_hand(vectors, k, rounds, size):
    """(id, cluster, distance, cluster_inertia, inertia, digest) with Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < 2**54 for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // own.count(j) for x in zip(*[v for (_, v), o in zip(kept, own) if o == j])] if j in own else y for j, y in enumerate(c)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    of = Counter()
    for _, j, d in last:
        of[j] += d
    fits = lambda x: x if x < 2**63 else None
    return sorted((i, j, fits(d), fits(of[j]), fits(sum(of.values())), brute.sha(",".join(map(str, c[j])))) for i, j, d in last)


@pytest.mark.parametrize(("k", "scale"), [(1, 1), (2, 1), (7, 1), (8, 3), (40, 1), (5, 9000), (6, 1e9)])
def test_clusters_equal_integer_arithmetic(spark, k, scale):
    """Few distinct values make many ties; large ones need integers beyond doubles."""
    rng = random.Random(k)
    rows = [(i, [float(rng.randint(-2, 2)) / (256 if scale == 1 else 1) * scale for _ in range(3)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (None, [0.0, 0.0, 0.0]), (5, [9.0, 9.0, 9.0]), (105, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = sorted(map(tuple, centroids.clustered(df, k, 4, 3).collect()))
    assert got == clusters_by_hand(rows, k, 4, 3)
    assert centroids.clustered(df.limit(0), k, 4, 3).collect() == []


def test_bisectors_over_ties_and_large_numbers():
    rng = np.random.default_rng(1)
    for high in (3, 50, 1 << 30):
        c = rng.integers(-high, high + 1, (11, 5))
        c[7], c[4] = c[2], c[3]  # equal centroids: the smaller number wins
        x = rng.integers(-high, high + 1, (300, 5))
        number, distance = centroids.Bisectors(c.tolist()).nearest(x)
        exact = ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
        assert number.tolist() == [min(range(11), key=lambda j: (row[j], j)) for row in exact.tolist()]
        assert [int(d) for d in distance] == [min(row) for row in exact.tolist()]


# ---------------------------------------------------------------- urls


def test_parts_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/5?x#y", "a.example.net", "/en/5", "example.net/en/"), ("https://example.net/fr/", "example.net", "/fr/", "net/"), ("x://net/", "net", "/", "net/"), ("x://net", "net", "", None), ("x://net?/", "net", "", None),
        ("x://notexample.com/de/", "notexample.com", "/de/", None), ("x://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/"), ("x://example.com/de", "example.com", "/de", None), ("x://a.org/fr/", "a.org", "/fr/", "org/fr/"),
        ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("://É.Net/É/\nb", "É.net", "/É/\nb", "net/"), ("a://b://c/d", "b:", "//c/d", None), ("x://internet/", "internet", "/", None),
    ]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, shape string")
    got = urls.judged(df, queries.URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [c[1:] for c in cases]
    assert all(r.verdict == (queries.URL_RULES[r.rule] if r.rule else "allow") for r in got)
    assert urls.judged(df.limit(0), queries.URL_RULES).collect() == []


def tree_by_hand(pages, rules, levels=4, support=20, prior=0.5, weight=10.0, purity=0.25, most=urls.CHI_SQUARE):
    """(page, verdict): the tree built with dictionaries."""
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        found = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return min(found, key=lambda r: (-len(r), r), default=None)

    def shape(path):
        out = []
        segments = path.removeprefix("/").replace("<", "%3C").split("/")
        for s in segments[:levels] + (["<**>"] if len(segments) > levels else []):
            end = (re.search(r"\.[a-z]{1,5}$", s) or [""])[0]
            stem = s.removesuffix(end) if end else s
            if re.fullmatch("[0-9a-f-]{16,}", stem) and re.search("[0-9]", s) and re.search("[a-f]", s):
                out.append("<x>" + end)
            elif re.fullmatch("[0-9]+", stem):
                out.append("<n>" + end)
            else:
                out.append(s)
        return "/".join(out)

    rows = []
    for page, url in pages:
        host, path = split(url)
        r = rule(host, path)
        rows.append((page, host, shape(path), rules.get(r)))
    template = {(h, s): "" for _, h, s, _ in rows}
    weight_of = Counter((h, s) for _, h, s, _ in rows)
    block, allow = (Counter((h, s) for _, h, s, v in rows if v == kind) for kind in ("block", "allow"))
    literal = lambda s: s != "" and not s.startswith("<")
    for level in range(levels + 1):
        count = Counter()
        part = {k: k[1].split("/")[level] if level < len(k[1].split("/")) else None for k in template}
        for k, t in template.items():
            count[k[0], t, part[k]] += weight_of[k]
        for k, t in list(template.items()):
            s = part[k]
            if s is not None:
                rare = literal(s) and count[k[0], t, s] < support
                template[k] = f"{t}/" + ("<*>" + (re.search(r"\.[a-z]{1,5}$", s) or [""])[0] if rare else s)
    for level in range(levels):
        sums = {}
        for k, t in template.items():
            own = sums.setdefault((k[0], t), [0, 0, 0])
            own[0] += block[k]
            own[1] += allow[k]
            own[2] += weight_of[k] - block[k] - allow[k]
        pools, moved = {}, {}
        for (h, t), (b, a, n) in sums.items():
            place = t.split("/")
            if level + 1 < len(place) and literal(place[level + 1]):
                label = "block" if b >= a and b >= n else "allow" if a >= n else "none"
                general = "/".join([*place[: level + 1], "<+>", *place[level + 2 :]])
                moved[h, t] = (h, general, label)
                pools.setdefault((h, general, label), []).append((b, a, n))
        for key, pool in moved.items():
            own, whole = sums[key], [sum(x) for x in zip(*pools[pool])]
            rest = [p - o for o, p in zip(own, whole)]
            n, m = sum(own), sum(rest)
            if m and sum((o * m - r * n) ** 2 / (n * m * p) for o, r, p in zip(own, rest, whole) if p) <= most:
                moved[key] = pool[1]
            else:
                moved[key] = None
        for k, t in list(template.items()):
            template[k] = moved.get((k[0], t)) or t
    good, bad = Counter(), Counter()
    for k, t in template.items():
        good[k[0], t] += allow[k]
        bad[k[0], t] += block[k]
    reject = lambda h, s: (good[h, template[h, s]] + prior * weight) / (good[h, template[h, s]] + bad[h, template[h, s]] + weight) < purity
    return sorted((p, v or ("block" if reject(h, s) else "allow"), reject(h, s)) for p, h, s, v in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_equals_dictionaries(spark, seed):
    """Blocked and allowed branches beside unlabelled ones, rare words, numbers, long identifiers, a large host."""
    rng = random.Random(seed)
    hosts = ["big.com"] * 8 + ["a.org", "b.big.com", "c.net"]
    sections = ["de", "en", "fr", "shop", "ads"]
    word = lambda: "".join(rng.choice("xyz") for _ in range(rng.randint(1, 4)))
    tails = [lambda: str(rng.randint(1, 99999)), lambda: f"{rng.randint(1, 99)}.html", word, lambda: f"{word()}/{rng.randint(1, 9)}/", lambda: hashlib.sha256(word().encode()).hexdigest()[:20] + ".php", lambda: "q/w/e/r/t/y", lambda: "", lambda: "<b>"]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(sections)}/{rng.choice(tails)()}") for i in range(900)] + [(-1, None), (-2, "x"), (-3, "http://big.com")]
    rules = {"big.com/de/": "block", "big.com/ads/x": "block", "big.com/ads/y": "block", "org/fr/": "allow", "net/": "block"}
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()
    assert sorted((r.page_id, r.verdict, r.template_rejected) for r in got) == tree_by_hand(pages, rules)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_url_query_on_its_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()
    got = queries.op13_url_filter(spark, DATA).collect()
    assert sorted((r.page_id, r.verdict, r.template_rejected) for r in got) == tree_by_hand([tuple(p) for p in pages], queries.URL_RULES)


def test_clusters_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op12_clusters"])
    assert sorted(rel.fetchall()) == sorted(map(tuple, queries.op12_clusters(spark, DATA).select(*rel.columns).collect()))


# ---------------------------------------------------------------- samples and long texts


def test_every_language_is_learned_from_a_full_budget(spark):
    """One long document a language is enough, and it is cut; the budget is filled in hash order."""
    texts = {f"l{i}": "".join(chr(0x61 + (i * 7 + j * (i + 1)) % 26) for j in range(50)) for i in range(20)}
    df = spark.createDataFrame([(i, lang, t * 40) for i, (lang, t) in enumerate(texts.items())] + [(90, "empty", ""), (91, None, "x")], "doc_id long, lang string, text string")
    model = langid.fit(df.select("doc_id", "text", "lang"), sample_chars=500)
    assert sorted(model.languages) == sorted(texts)
    assert [p for p, _ in model.predict([t * 3 for t in texts.values()])] == list(texts)
    many = spark.createDataFrame([("a", i, "x" * (i % 50)) for i in range(2000)] + [("b", 5000, "y" * 100000)], "group string, id long, text string")
    known = samples.told(many, "id").join(many.select("id", "group", F.xxhash64("text").alias("tie")).distinct(), ["id", "tie"])
    got = samples.drawn(known, many.drop("group"), "s", None, 300, "id")
    assert Counter({g: sum(len(t) for h, _, t in got if h == g) for g in "ab"}) == {"a": 300, "b": 300}
    assert len(samples.drawn(known, many.drop("group"), "s", 7, 10**6, "id")) == 8 and samples.drawn(known.limit(0), many.drop("group"), "s", 7, 10, "id") == []
    rows, labels = toxicity.sampled(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, label int"), 5)
    assert (rows, labels) == (["a"], [1])


def test_a_long_text_with_one_phrase_is_hot(spark):
    """A phrase in a single page is counted in full, so its group is split; texts of some MB, clashing columns."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    phrase = " ".join(word() for _ in range(12))
    long = " ".join(f"{word()} {phrase} {word()}" for _ in range(9000))
    docs = {1: long, 2: f"{word()} {phrase} {word()} end", 3: None, 4: phrase}
    df = spark.createDataFrame([(d, t, 1, b"x", 2) for d, t in docs.items()], "doc_id long, text string, page int, key binary, n int")
    assert repeats.TIMES >= repeats.HOT  # what a page counts is enough to tell
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in substrings.dedup_words(df).collect()}
    assert got == brute.word_windows(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in substrings.dedup_bytes(df).collect()}
    assert got == brute.byte_windows(docs)
