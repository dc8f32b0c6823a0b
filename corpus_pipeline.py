"""A corpus pipeline of the operators in ``counterloom.llm``: each stage reads what the one before it wrote.

Every stage decides by the text of a row, whatever its id: rows without one are filtered like others, and of rows that share an id
each stands for its own text. Extra columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterloom.llm import chosen_path, decontaminate, packing, quality_model, surrogates
from counterloom.llm.queries import SURROGATE_KEY, held_out, tokenizer
from counterloom.llm.store import text_digest, written


def without_texts(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows whose text has none of the ``digests``."""
    out = digests.select(F.col("digest").alias("_digest")).distinct()
    return docs.join(out, text_digest(F.col("text")) == F.col("_digest"), "left_anti").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects: a score below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    rejected = quality_model.quality_scores(docs, labels, digests=True).where("score < 0.3").select("digest")
    return without_texts(docs, rejected)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies keep one row: that with the smallest id, a row without id only where none has one; of rows that
    share it the one whose text has the smallest digest. The join sees a number of each row in place of its id."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    classes = chosen_path.similar_documents(rows.select("_row", "text"), doc_id="_row").select(F.col("doc_id").alias("_row"), "class_id")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), text_digest(F.col("text")), F.col("_row"))
    first = rows.select("_row", rank.alias("_rank")).join(classes, "_row").groupBy("class_id").agg(F.min("_rank")["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return without_texts(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), digests=True))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text; ``n_chars`` follows the new text."""
    return surrogates.replace_personal_data(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document in sequences of at most 2048."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality-classifier", keep_quality),
    ("near-duplicates", keep_first_copies),
    ("decontamination", keep_uncontaminated),
    ("personal-data", replace_personal_data),
    ("packing", pack),
]

#: The trained classifier, the randomised join and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
