"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.tables import table
from assayer.llm import align, bpe, centroids, decontaminate, embeddings, langid, lines, minhash, secrets, substrings, toxicity, urls
from assayer.llm.session import tuned


#: Fixed values of op13: what a rule's host and path say.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, grammar, into="score")
    return out.select("doc_id", (langid.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(tuned(spark), sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(tuned(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_bytes(table(tuned(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.remainder(F.col("doc_id"), 4) != 2))
    out = langid.predicted(docs, model)
    return out.select("doc_id", (langid.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "language.*")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenized(docs, vocabulary(), fields=("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "bpe.*")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_words(table(tuned(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(tuned(spark), sf_dir, "documents"), k=4)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(tuned(spark), sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_line_dedup": op3_line_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_minhash": op9_minhash,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_clusters": op12_clusters,
    "op13_url_filter": op13_url_filter,
}

#: Every window that shares a shingle with an item, at every start, compared exactly, without fingerprints.
LEAKS_SQL = r"""
WITH w AS (SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT item_id AS id, list_filter(string_split(trim(regexp_replace(lower(min(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
      FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL GROUP BY item_id),
bs AS (SELECT id, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS n, w FROM b WHERE len(w) > 0),
be AS (SELECT id, k, n, unnest(list_transform(range(1, n + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS h FROM bs),
ds AS (SELECT id, k, len(w) - k + 1 AS n, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS s
       FROM w, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k),
de AS (SELECT id, k, n, unnest(s) AS h, unnest(range(0, n)) AS pos FROM ds),
hit AS (SELECT DISTINCT de.id AS doc_id, de.k, be.n AS size, least(de.n, be.n) AS own, de.n, pos FROM de JOIN be ON be.k = de.k AND be.h = de.h),
win AS (SELECT DISTINCT doc_id, k, size, own, unnest(range(greatest(0, pos - own + 1), least(pos, n - own) + 1)) AS start FROM hit),
ws AS (SELECT doc_id, win.k, size, own, start, unnest(s[start + 1 : start + own]) AS h FROM win JOIN ds ON ds.id = doc_id AND ds.k = win.k),
wc AS (SELECT doc_id, k, size, own, start, h, count(*) AS c FROM ws GROUP BY ALL),
bc AS (SELECT id AS item_id, k, n AS size, h, count(*) AS c FROM be GROUP BY ALL),
shared AS (SELECT doc_id, item_id, wc.k, wc.size, start, own, sum(least(wc.c, bc.c)) AS both_n FROM wc JOIN bc ON wc.h = bc.h AND wc.size = bc.size AND wc.k = bc.k GROUP BY ALL),
scored AS (SELECT *, both_n::DOUBLE / (own + size - both_n)::DOUBLE AS similarity FROM shared),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM scored WHERE similarity >= 0.8)
SELECT doc_id, item_id, start AS start_word, size + k - 1 AS n_words, similarity FROM ranked WHERE r = 1"""

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: All pairs of vectors, then closure.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
lab(id, l) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, l.l FROM lab l JOIN edge e ON e.a = l.id),
c AS (SELECT id, min(l) AS component_id FROM lab GROUP BY id), n AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
SELECT id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id"""

#: Every window of every document, by its words.
WINDOWS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM win JOIN least USING (s) WHERE doc_id > first_doc),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS t, count(*) AS n FROM word w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)"""

#: Every byte window, as text of hexadecimal digits.
BYTES_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
isle AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM dup)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM isle GROUP BY doc_id, k),
next AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM span),
kept AS (SELECT n.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, substr(any_value(h), 1, 2 * min(a)) || string_agg(substr(h, 2 * b + 1, coalesce(2 * (c - b), len(h))), '' ORDER BY a) AS t FROM next n JOIN d USING (doc_id) GROUP BY n.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Pairs that share a shingle, counted exactly, then closure.
NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
edge AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n + y.n - both_n)),
lab(id, l) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, l.l FROM lab l JOIN edge e ON e.a = l.id),
c AS (SELECT id, min(l) AS component_id FROM lab GROUP BY id)
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.id"""



def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """All distances in every round; sums and floors in integers."""
    out = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS n, e AS c FROM (SELECT * FROM v ORDER BY sha256('2:' || vec_id), e LIMIT {k}))""".format(k=k)
    for i in range(rounds + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT vec_id, e, min(struct_pack(d := (list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c))::BIGINT, n := n)) AS best FROM v, c{i} GROUP BY vec_id, e)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT n, place, sum(x::BIGINT) AS s, count(*) AS m FROM (SELECT best.n AS n, unnest(e) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY n, place),
m{i} AS (SELECT n, list(((s - ((s % m) + m) % m) // m)::DOUBLE ORDER BY place) AS c FROM s{i} GROUP BY n),
c{i + 1} AS MATERIALIZED (SELECT c{i}.n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.n = c{i}.n)"""
    return out + f"""
SELECT vec_id, best.n::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.n)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON n = best.n"""


def urls_sql(levels: int = 4, support: int = 20) -> str:
    """Rules, then the tree level by level with windows over whole nodes."""
    rules = sorted(URL_RULES, key=lambda r: (-len(r), r))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{rest}') THEN '{h}/{rest}'" for h, _, rest in (r.partition("/") for r in rules))
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items())
    literal = "coalesce(s <> '' AND NOT starts_with(s, '<'), false)"
    end = r"(\.[a-z]{1,5})?$"
    out = rf"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE {fits} END AS rule, string_split(regexp_replace(replace(path, '<', '%3C'), '^/', ''), '/') AS seg FROM p),
k AS (SELECT * EXCLUDE (seg), CASE rule {verdict} END AS said, array_to_string(list_transform(CASE WHEN len(seg) > {levels} THEN list_append(seg[1:{levels}], '<**>') ELSE seg END, lambda s:
  CASE WHEN regexp_matches(s, '^[0-9a-f-]{{16,}}{end}') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-f]') THEN regexp_replace(s, '^[0-9a-f-]+{end}', '<x>\1') ELSE regexp_replace(s, '^[0-9]+{end}', '<n>\1') END), '/') AS shape FROM r),
t0 AS (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE said = 'block') AS block, count(*) FILTER (WHERE said = 'allow') AS allow, '' AS template FROM k GROUP BY host, shape)"""
    for i in range(levels + 1):
        out += rf""",
t{i + 1} AS (SELECT host, shape, n, block, allow, CASE WHEN s IS NULL THEN template WHEN {literal} AND pages < {support} THEN template || '/<*>' || regexp_extract(s, '\.[a-z]{{1,5}}$') ELSE template || '/' || s END AS template
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, template, s) AS pages FROM (SELECT *, string_split(shape, '/')[{i + 1}] AS s FROM t{i})))"""
    at = levels + 1
    term = lambda c: f"CASE WHEN w.all_{c} > 0 THEN (w.{c} * w.m - (w.all_{c} - w.{c}) * w.n) * (w.{c} * w.m - (w.all_{c} - w.{c}) * w.n) / (w.n * w.m * w.all_{c}) ELSE 0.0 END"
    for i in range(levels):
        out += f""",
b{i} AS (SELECT *, string_split(template, '/') AS place, string_split(template, '/')[{i + 2}] AS s FROM (SELECT host, template, sum(block)::DOUBLE AS block, sum(allow)::DOUBLE AS allow, sum(n - block - allow)::DOUBLE AS none FROM t{at + i} GROUP BY host, template)),
g{i} AS (SELECT *, array_to_string(list_concat(place[1:{i + 1}], ['<+>'], place[{i + 3}:]), '/') AS general, CASE WHEN block >= allow AND block >= none THEN 'block' WHEN allow >= none THEN 'allow' ELSE 'none' END AS label FROM b{i} WHERE {literal}),
w{i} AS (SELECT *, all_block + all_allow + all_none - n AS m FROM (SELECT *, block + allow + none AS n, sum(block) OVER x AS all_block, sum(allow) OVER x AS all_allow, sum(none) OVER x AS all_none FROM g{i} WINDOW x AS (PARTITION BY host, general, label))),
t{at + i + 1} AS (SELECT t.host, t.shape, t.n, t.block, t.allow, coalesce(w.general, t.template) AS template FROM t{at + i} t LEFT JOIN w{i} w ON w.host = t.host AND w.template = t.template AND w.m > 0 AND {term("block")} + {term("allow")} + {term("none")} <= {urls.CHI_SQUARE})"""
    return out + f""",
f AS (SELECT host, shape, (sum(allow) OVER x + 5.0) / (sum(allow) OVER x + sum(block) OVER x + 10.0) < 0.25 AS bad FROM t{at + levels} WINDOW x AS (PARTITION BY host, template))
SELECT page_id, k.host, path, rule, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, bad AS template_rejected FROM k JOIN f ON f.host = k.host AND f.shape = k.shape"""


ORACLE_SQL = {
    "op13_url_filter": urls_sql(),
    "op12_clusters": clusters_sql(),
    "op4_embedding_dedup": VECTORS_SQL,
    "op5_suffix_dedup": BYTES_SQL,
    "op8_substring_dedup": WINDOWS_SQL,
    "op9_minhash": NEAR_SQL,
    "op10_decontamination": LEAKS_SQL,
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, l AS line, translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
hot AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, (h.key IS NOT NULL AND l.doc_id <> h.keeper) AS gone FROM lines l LEFT JOIN hot h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
