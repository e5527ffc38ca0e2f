"""A cleaning pipeline over ``documents``: each stage is one operator, written as Parquet and read again for the next.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.  Rows are told apart by a row number where
an operator needs ids, so null or repeated ids lose no document.  An empty table gives no rows; columns beyond those of ``documents`` are carried
through all stages but the last, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, near_dup, packing, pii, toxicity
from brindle.llm._common import small, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is probably above 0 go; null and empty texts have no telling word and stay; without labels nothing goes."""
    grades = toxicity.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, toxicity.train(docs, grades))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more).

    Rows have a number of their own here, under a name that no column has, so null and repeated ids lose nothing; texts without words have no duplicates.
    """
    row = next(c for c in (f"row{i}" for i in range(len(docs.columns) + 1)) if c not in {x.lower() for x in docs.columns})
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = small(written(near_dup.near_duplicates(rows, id_col=row).where("not kept").select(row)))
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go; null and empty texts and an empty benchmark let all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets and ``n_chars`` follows; every document stays, a null text stays null."""
    out = pii.redact_pii(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, packed into sequences of 4096 tokens; a null or empty text is one piece of its end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
