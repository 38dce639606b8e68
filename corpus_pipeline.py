"""A corpus pipeline over documents: toxicity, near-duplicates, benchmark leaks, secrets, tokens.

Every stage works on all rows that its predecessor kept and carries all columns, whatever their names. Defined results
that hold for each: a null or empty text, and a null doc_id, are a document like any other; repeated rows are judged one
by one (but for the near-duplicates, of which one stays); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from termweave.llm.common import cut, importable

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def _packed(docs: DataFrame) -> DataFrame:
    """All columns as one, so that no operator's own names clash with them."""
    return docs.select(F.struct("*").alias("_doc"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of those at hand, does not call toxic.

    Those without text score as the model's intercept does. Without labels of both kinds none goes."""
    importable(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.classify(_packed(docs), model, ("_doc",)).where("predicted = 0").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id; null ids last, ties by row.

    Documents without words are in no group, so all of them stay; so do texts that only share fewer words than a shingle."""
    importable(spark)
    return near_dedup.deduplicate(docs, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null texts and items, and an empty benchmark, hit nothing."""
    importable(spark)
    found = decontaminate.find_overlap(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("_doc",))
    return found.where("NOT contaminated").select("_doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars brought up to date. A null text stays, with its n_chars."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their tokens (ids, n_tokens; own columns of these names give way). A null text has none."""
    importable(spark)
    return bpe.with_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs


#: The classifier, similarity groups and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
