"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import oracle
from auditlake.llm.divergence import source_divergence
from auditlake.llm.fingerprint import compare_neighbours
from auditlake.llm.langid import held_out, identify, train
from auditlake.llm.minhash import near_duplicates
from auditlake.llm.mixing import mix
from auditlake.llm.negatives import hard_negatives
from auditlake.llm.packing import packed_ids, row_digest
from auditlake.llm.passages import repeated_passages
from auditlake.llm.pieces import encoded, id_digest
from auditlake.llm.repetition import repetition_rules
from auditlake.llm.secrets import secret_spans, span_digest
from auditlake.llm.urlgraph import Propagation, Rule, judged_urls
from auditlake.llm.wordbpe import word_ids, word_texts

QUERIES, ORACLE = {}, {}

#: Folder of public vocabulary files on every executor.
TOKENIZERS = "/opt/tokenizers"
#: How byte_bpe_50k cuts a text before merging (a fixed value of that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
]
_LINKS = Propagation()


@query("op1_url_graph", oracle.url_graph([(r.verdict, r.host, r.path) for r in URL_RULES], _LINKS.damping, _LINKS.rounds, _LINKS.bound))
def op1_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return judged_urls(table(spark, sf_dir, "pages"), URL_RULES, _LINKS)


@query("op2_near_duplicates", oracle.NEAR_DUPLICATES)
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose shingle sets are 85 % alike."""
    return near_duplicates(table(spark, sf_dir, "documents"), Fraction(85, 100))


@query("op3_secret_spans")
def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of secrets in every document."""
    return span_digest(secret_spans(table(spark, sf_dir, "documents")))


@query("op4_merge_dropout")
def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout of a tenth, and whether they decode to it."""
    return id_digest(encoded(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", seed=1, dropout=0.1))


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix of one and a half times all words takes each document."""
    mixed = mix(table(spark, sf_dir, "documents"), [3, 1, 2], share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op7_repeated_passages")
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 50-byte strings of documents before it."""
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op8_repetition_rules")
def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document's inner repetition."""
    return repetition_rules(table(spark, sf_dir, "documents"))


@query("op9_packed_ids")
def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2048 ids that hold all documents."""
    return row_digest(packed_ids(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its neighbour."""
    return compare_neighbours(table(spark, sf_dir, "documents"))


@query("op11_source_divergence", oracle.SOURCE_DIVERGENCE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source differ from those of the other sources of its language."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", oracle.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score a little below each anchor's positives; every 7th label is noisy."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op13_word_bpe")
def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by word BPE and what they decode to."""
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    rows = word_texts(word_ids(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
