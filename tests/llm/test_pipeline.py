"""The pipeline against plain Python: each stage on what its predecessor kept."""

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayer.llm import toxicity
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    for name, f in P.STAGES:
        docs = f(spark, docs, DATA).cache()
        out.append((name, docs))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in stages] == ["toxicity", "line dedup", "minhash near-dedup", "benchmark decontamination", "bpe encoding"]
    assert all(d.columns == list(P.COLUMNS) for _, d in stages[:-1])


def test_each_stage(spark, stages):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    grammar = toxicity.fitted(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {d: r.text for d, r in docs.items() if grammar.score(r.text) < P.TOXIC}
    assert ids(stages[0][1]) == set(want)
    want = {d: v[2] for d, v in brute.lines(want).items()}
    got = stages[1][1].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    want = {d: want[d] for d, (_, _, kept) in brute.near(want, 5).items() if kept}
    assert ids(stages[2][1]) == set(want)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    gone = {d for d, _ in brute.leaks(want, items)}
    assert gone and ids(stages[3][1]) == set(want) - gone
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = {r.doc_id: r for r in stages[4][1].collect()}
    assert set(encoded) == set(want) - gone
    for d, r in encoded.items():
        e = library.encode(want[d], add_special_tokens=False)
        assert r.n_tokens == len(e.ids) and np.frombuffer(r.ids, "<u4").tolist() == e.ids and r.decoded_sha256 == brute.sha(library.decode(e.ids, skip_special_tokens=False))


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(str, P.run(spark, DATA).collect())) == sorted(map(str, stages[-1][1].collect()))


def test_empty_and_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a", None, None, None), (1, None, "en", "s", None), (2, "", None, "s", 0), (2, "b c", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "x y z q r s")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    # rows without an id and different texts of one id are documents of their own
    assert sorted((r.doc_id or 0, r.lang or "", r.n_tokens) for r in P.run(spark, str(tmp_path)).collect()) == [(0, "", 1), (1, "en", 0), (2, "", 0), (2, "en", 2)]
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
