"""Corpus pipeline: language ID, near-dedup, PII, mixing to target weights, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows its predecessor kept and returns a DataFrame.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyrisk.llm.common import materialise
from polyrisk.llm.langid import UNDETERMINED, predict, train
from polyrisk.llm.mixing import mix
from polyrisk.llm.neardup import near_duplicates
from polyrisk.llm.packing import pack
from polyrisk.llm.pii import pseudonymise
from polyrisk.llm.queries import PII_KEY, TARGETS, TOKENIZERS, domains, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has a smaller posterior is rejected.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language (learned from the labelled ones); ``lang`` is kept as it is."""
    model = train(docs.where(F.col("lang").isNotNull()), f"{TOKENIZERS}/piece_bpe_32k.model")
    return predict(docs.select(*COLUMNS), model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Near duplicates share at least 0.8 of their five-word shingles; 30 bands
    of 5 rows let a pair at that similarity slip with a chance below 1e-5.
    Rows that repeat an id and its text are one document; rows without an id
    are all kept.
    """
    kept = near_duplicates(docs, percent=80, bands=30, rows=5).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("__text", F.xxhash64("text"))
    named = named.dropDuplicates(["doc_id", "__text"]).select(*COLUMNS)
    return named.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; ``n_chars`` follows the text."""
    out = pseudonymise(docs.select(*COLUMNS), PII_KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the target weights ask for (none for some)."""
    mixed = mix(docs.select(*COLUMNS), domains(table(spark, sf_dir, "labels")), TARGETS)
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("PII", pii),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

#: Language scores, the classifier and packing have no SQL form (see tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return docs
