"""From documents to training ids: five stages, each one of the operators of auditlake.llm."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.langid import known_language, train
from auditlake.llm.minhash import near_duplicates
from auditlake.llm.mixing import mixed_rows
from auditlake.llm.pieces import encoded
from auditlake.llm.queries import TOKENIZERS, table
from auditlake.llm.secrets import without_secrets
from auditlake.llm.shared import collect_executors, screened, written

#: Columns of a stage's own, named so that none of the documents' columns is in the way.
ROW, GROUP, FIRST, LIKELY = (f"__pipeline_{name}" for name in ("row", "group", "first", "likely"))

#: Stages have no SQL: trained models and keyed hashes decide in them. tests/llm checks them.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose language is rejected: no letters, or no language is likely."""
    return known_language(docs, train(docs))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key: a hash of the row, as an id alone may be null or repeated. Equal rows have one key."""
    key = F.xxhash64(*(F.col(c).cast("string") for c in ("doc_id", "source", "text", "lang")))
    return docs.withColumn(ROW, key)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, one row of it; rows
    without an id are groups of equal texts. Rows with an empty set of words are no copies.
    """
    keyed = _keyed(docs)
    found = near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text"), Fraction(4, 5))
    group = found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias(GROUP)).distinct()
    each = keyed.groupBy(ROW).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("id"), F.count("*").alias("n"))
    rows = each.join(group, ROW)
    first = rows.groupBy(GROUP).agg(F.min(F.struct("id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW), F.lit(True).alias(FIRST))
    # Rows that go or are repeated. The texts of the others, nearly all, stay where they are.
    told = rows.join(first, ROW, "left").where(F.col(FIRST).isNull() | (F.col("n") > 1))
    told = written(told.select(ROW, F.coalesce(FIRST, F.lit(False)).alias(FIRST)), "told")
    # All shuffles of size are over; the stages from here on work in Python, beside the JVM.
    collect_executors(spark)
    keyed = screened(keyed, ROW, told.select(ROW), LIKELY)
    judged = keyed.where(LIKELY).join(told, ROW, "left").where(F.coalesce(FIRST, F.lit(True))).dropDuplicates([ROW])
    return keyed.where(~F.col(LIKELY)).select(docs.columns).union(judged.select(docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document goes."""
    return without_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2, repeating, as many words as there are; a document comes 0 to 2 times."""
    rows = _keyed(docs.select("doc_id", "source", "text", "lang", F.struct(docs.columns).alias("row"))).withColumn("doc_id", F.col(ROW))
    taken = mixed_rows(rows, [3, 1, 2], share=1.0, most=2).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and lossless: the ids of each document under merge-dropout."""
    return encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model", seed=1, dropout=0.1)


STAGES = [
    ("language", language), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("ids", ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes its rows before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
