"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage
returns to the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from docmeter.llm.common import col, fresh, materialize, read_table, scratch
from docmeter.llm.queries import RANK_FILE


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from the labelled documents of the table."""
    index = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    names = tuple(fresh(docs, "score", "predicted", "evidence"))
    return toxicity.classify(docs, index, outputs=names).where(F.col(names[1]) == 0).select(*map(col, docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that nearly repeat an earlier line; documents with nothing left go. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row: the smallest doc_id's, null last. Rows without words are copies of none and stay."""
    # Rows are told apart by a number of their own, as ids may be null or repeated.
    (row,) = fresh(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows", keep=True)
    found = jaccard_join.jaccard_components(rows, key=row).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row)
    first = found.join(rows.select(row, order.alias("o")), row).groupBy("component_id").agg(F.min("o")[row].alias(row))
    return rows.join(first.select(row), row, "left_semi").select(*map(col, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digest of the bytes that they decode to."""
    import public_tokenizers

    rank_file, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    out = bpe.encode_decode(docs.select("doc_id", "source", "text"), rank_file, pattern)
    return out.select("doc_id", "source", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: SQL can't express the first stage; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages before it wrote is deleted once the next one has been written."""
    docs = read_table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):
                done = stage(spark, docs, sf_dir)
                path = "pipeline-" + "".join(c if c.isalnum() else "-" for c in name)
                docs = materialize(done, path, keep=True)
        return materialize(docs, "pipeline", keep=True)
