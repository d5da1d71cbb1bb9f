"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents.

toxicity (documents that it rejects go), line dedup, MinHash near-dedup (one document of each group stays), benchmark
decontamination (documents with a benchmark passage go), BPE encoding. All stages but the last return the columns of
documents; other columns are dropped by the first.

Defined results: null texts are empty from the second stage on; a document goes only on its stage's grounds. Rows without
doc_id, and different texts of one doc_id, are documents of their own: their lines are deduplicated like others', they
have no part in near-dedup (which names groups by doc_id) and stay, except that equal rows become one; a passage of the
benchmark in one text of a doc_id removes all of them. Ties: the largest doc_id keeps a line, the smallest stands for its
group. Long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.tables import table, written
from assayer.llm import bpe, decontaminate, lines, minhash, toxicity
from assayer.llm.queries import vocabulary
from assayer.llm.session import tuned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below TOXIC."""
    grammar = toxicity.fitted(docs, table(tuned(spark), sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), grammar, into="_score").where(F.col("_score") < TOXIC).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without frequent lines; n_chars follows the text. A document is a doc_id with one of its texts."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("k"), *COLUMNS)
    rest = keyed.groupBy("k").agg(F.min(F.struct("lang", "source")).alias("r"))
    kept = lines.dedup_lines(keyed, doc="k").select(F.col("doc_id").alias("k"), "text")
    out = rest.join(kept, "k").select("k.doc_id", "text", "r.lang", "r.source")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    tuned(spark)
    odd = written(docs.groupBy(F.col("doc_id").alias("odd")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or odd is null").select("odd"), "odd")
    some = odd.limit(1).count() > 0
    plain = docs.join(odd, docs["doc_id"].eqNullSafe(odd["odd"]), "left_anti") if some else docs
    kept = minhash.near_duplicates(plain).where("kept").select("doc_id")
    out = plain.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    return out.unionByName(docs.join(odd, docs["doc_id"].eqNullSafe(odd["odd"]), "left_semi").select(*COLUMNS).distinct()) if some else out


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text's digest."""
    tuned(spark)
    out = bpe.tokenized(docs, vocabulary(), fields=("n_tokens", "ids", "decoded_sha256"))
    return out.select("doc_id", "lang", "source", "bpe.*")


STAGES = [
    ("toxicity", clean),
    ("line dedup", without_repeated_lines),
    ("minhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("bpe encoding", encoded),
]

#: The learned toxicity grammar and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
