"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontamination, exact_dedup, hard_negatives, jaccard_join, language_id, line_dedup, mixing, periodic_runs, secret_scan, sharding, toxicity
from .common import read_table

RANK_FILE, SHARDS = "byte_bpe_multi_50k.tiktoken", 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(read_table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rank_file, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, rank_file, pattern)
    return out.select(
        "doc_id",
        bpe.token_count(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_held_out(4, 2), F.lit(False))
    model = language_id.learn(docs.where(~held_out))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_held_out(5, 0), F.lit(False))
    index = toxicity.learn(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.classify(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.duplicate_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("drop").alias("n_dropped"), F.col("drop").alias("dropped_lines"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    out = mixing.expected_copies(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), level AS (  -- a round: sources above their cap stop there, the others share what is left
  SELECT 0 AS round, source, source_size, w, false AS capped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, capped OR w * "left" / "weight" >= 2.0::DOUBLE * source_size
  FROM (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER (PARTITION BY round)
              - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (capped) OVER (PARTITION BY round), 0) AS "left",
           sum(w) FILTER (NOT capped) OVER (PARTITION BY round) AS "weight"
    FROM level) WHERE round < (SELECT count(*) FROM s)
), final AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE w * "left" / "weight" END AS target
  FROM (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (capped) OVER (), 0) AS "left",
           sum(w) FILTER (NOT capped) OVER () AS "weight"
    FROM level WHERE round = (SELECT count(*) FROM s))
), placed AS (
  SELECT doc_id, size, source_size, target, d.source,
         row_number() OVER (PARTITION BY d.source ORDER BY size, md5('17:' || coalesce(doc_id::VARCHAR, '')), doc_id) AS pos,
         ('0x' || substr(md5('17:source:' || coalesce(d.source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS off,
         CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN final f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target,
       ((floor(off + rate * pos) - floor(off + rate * (pos - 1)))::BIGINT * size)::BIGINT AS taken
FROM placed
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return found.withColumn("base", F.filter("spans", lambda x: x["kind"] < 3)).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document; see ``decontaminate`` for nulls, repeated rows and empty tables."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), x AS (
  SELECT r, s, list(word) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS s FROM d)
), g AS (SELECT r, k, s, array_to_string(x[1:k], ' ') AS win FROM x, (SELECT DISTINCT k FROM win) WHERE len(x) >= k
), hit AS (SELECT r, s, g.k, item_id FROM g JOIN win USING (win, k)
), n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r
), t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a negative; see ``hard_negatives`` for the rows that take part, ties, repeated keys and empty tables."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # From 2^53 on all doubles are whole; infinity and NaN stay, so that the operator leaves their rows out.
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(256 * x) < 2.0**53, F.floor(256 * x).cast("double")).otherwise(256 * x))
    out = hard_negatives.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("embedding")), lambda key: key % 100 == 0)
    return out.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


def planted_repeats(key: int | None, words: list[bytes]) -> list[bytes]:
    """In a tenth of the documents, by crc32 of the id, the words from some place on repeat the first few of them."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document; null texts have no runs and the hash of nothing. See ``collapse_runs`` for the other cases."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs.collapse_runs(docs, rewrite=planted_repeats)
    # The greatest length over period; ties keep the order, which is by start and period.
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    out = out.withColumn("top", F.reduce("runs", F.get("runs", F.lit(0)), better))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_bpe": op2_bpe,
        "op3_langid": op3_langid,
        "op4_jaccard": op4_jaccard,
        "op5_toxicity": op5_toxicity,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_mixing": op8_mixing,
        "op9_secrets": op9_secrets,
        "op10_ann": op10_ann,
        "op11_decontamination": op11_decontamination,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op11_decontamination": OP11_SQL, "op12_hard_negatives": OP12_SQL}
