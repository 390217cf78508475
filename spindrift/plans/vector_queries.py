"""Vector, reranking, codec and model queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import clip
from spindrift.functions.models import BpeCounter, HashEmbedder, OverlapScorer, count_udf, overlap_score, score_udf
from spindrift.functions.vectors import cosine, l2_normalize, ranks, score_max, score_min, spearman
from spindrift.operators.serving import embed_texts, prefer_quantized, rerank
from spindrift.sources.tables import table
from spindrift.sources.vector_stream import decode_blocks, encode_blocks


def vec_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.transform("embedding", lambda x: (x.cast("double") * (1 + F.col("vec_id") % 7)).cast("float"))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(l2_normalize(doubled)).alias("pos", "value"))
    return unit.select("vec_id", "pos", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


def vec_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one by id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")).cast("double"), 4).alias("cosine"))


def _pairs(spark: SparkSession, sf_dir: str, score=overlap_score) -> DataFrame:
    """Every document as a prompt of a benchmark item; documents are dealt over all items in the order of their ids."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("request_id"), F.col("text").alias("query"))
    dealt = F.pmod(F.col("doc_id"), F.lit(max(items.count(), 1)).cast("long"))
    asked = docs.select(dealt.alias("request_id"), F.col("doc_id").alias("pos"), F.col("text").alias("prompt"), "n_chars")
    return rerank(asked.join(ranked, "request_id"), score)


def rerank_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("request_id", "pos", F.round(F.col("score").cast("double"), 5).alias("score"))


def rerank_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from a model behind a vectorised UDF."""
    return _pairs(spark, sf_dir, score_udf(OverlapScorer)).select("request_id", "pos", F.round(F.col("score").cast("double"), 5).alias("score"))


def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(_pairs(spark, sf_dir), "request_id", "score", "pos", "rank").select("request_id", "pos", "rank")


def spearman_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(_pairs(spark, sf_dir), "request_id", "score", "n_chars", "pos").select("request_id", "n", F.round("rho", 6).alias("rho"))


def score_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _pairs(spark, sf_dir).groupBy("request_id").agg(F.collect_list("score").alias("scores"))
    return grouped.select("request_id", F.round(score_min(F.col("scores")).cast("double"), 5).alias("low"), F.round(score_max(F.col("scores")).cast("double"), 5).alias("high"))


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors per label through the binary stream and back."""
    back = decode_blocks(encode_blocks(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding"))
    rows = back.select(F.explode(F.arrays_zip("ids", "vectors")).alias("r")).select(F.col("r.ids").alias("vec_id"), F.col("r.vectors").alias("v"))
    return rows.select("vec_id", F.size("v").alias("dimensions"), F.round(F.element_at("v", 1).cast("double"), 5).alias("first"), F.round(F.element_at("v", -1).cast("double"), 5).alias("last"))


def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = encode_blocks(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return blocks.groupBy("label").agg(F.sum(F.octet_length("payload") - 16).alias("payload_bytes"))


def embed_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed_texts(docs, lambda: HashEmbedder(32)).select("doc_id", F.size("embedding").alias("dimensions"), F.round(cosine(F.col("embedding"), F.col("embedding")).cast("double"), 4).alias("norm"))


def clip_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = clip.tokenize_udf(public_tokenizers.path("word_bpe_49k.json"))(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("t")).select("conv_id", "turn", "t.ids", F.aggregate("t.mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"))


#: A projection of 64 dimensions to three, by a rule.
PROJECTION = [[((row + 1) * (col + 2) % 7 - 3) / 4 for col in range(64)] for row in range(3)]


def clip_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(clip.project(F.col("embedding"), PROJECTION)).alias("pos", "value"))
    return found.select("vec_id", "pos", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


def bpe_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return table(spark, sf_dir, "documents").select("doc_id", count_udf(lambda: BpeCounter(ranks_path, pattern))(F.col("text")).alias("n_tokens"))


def quantized_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_size")).alias("model"), F.when(F.col("p_partkey") % 5 == 0, "model_i8.onnx").otherwise("model.onnx").alias("file"))
    return prefer_quantized(d)


QUERIES = {
    "vec_l2_normalize": vec_l2_normalize, "vec_cosine_pairs": vec_cosine_pairs, "rerank_stub": rerank_stub, "rank_scores": rank_scores, "spearman": spearman_query,
    "score_min_max": score_min_max, "codec_roundtrip": codec_roundtrip, "codec_sizes": codec_sizes, "embed_stub": embed_stub, "clip_tokenize": clip_tokenize,
    "bpe_token_count": bpe_token_count, "quantized_first": quantized_first, "rerank_model": rerank_model, "clip_project": clip_project}

_PAIRS = r"""
    WITH d AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS request_id, doc_id AS pos, n_chars, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS pw FROM documents),
    q AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS request_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS qw FROM benchmark),
    p AS (SELECT request_id, pos, n_chars, CASE WHEN len(qw) = 0 THEN 0.0 ELSE len(list_intersect(qw, pw)) / len(qw) END::FLOAT AS score FROM d JOIN q USING (request_id))"""
ORACLE_SQL = {
    "vec_l2_normalize": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * (1 + vec_id % 7))::FLOAT) AS v FROM embeddings),
        n AS (SELECT vec_id, v, list_reduce(list_transform(v, lambda x: (x * x)::FLOAT), lambda a, x: (a + x)::FLOAT, 0::FLOAT) AS total FROM e),
        s AS (SELECT vec_id, v, total, (1.0 / sqrt(total::DOUBLE))::FLOAT AS scale FROM n)
        SELECT vec_id, (i - 1)::INT AS pos, round(CASE WHEN total = 0 THEN v[i] ELSE (v[i] * scale)::FLOAT END::DOUBLE, 4) + 0.0 AS value FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM s)""",
    "vec_cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "rerank_stub": _PAIRS + " SELECT request_id, pos, round(score::DOUBLE, 5) AS score FROM p",
    "rerank_model": _PAIRS + " SELECT request_id, pos, round(score::DOUBLE, 5) AS score FROM p",
    "clip_project": """
        WITH m AS (SELECT r, list_transform(generate_series(0, 63), lambda c: ((r + 1) * (c + 2) % 7 - 3) / 4.0) AS w FROM generate_series(0, 2) g(r)),
        d AS (SELECT vec_id, r, list_dot_product(embedding::DOUBLE[], w::DOUBLE[]) AS x FROM embeddings, m)
        SELECT vec_id, r::INT AS pos, round(CASE WHEN sum(x * x) OVER v = 0 THEN x ELSE x / sqrt(sum(x * x) OVER v) END, 4) + 0.0 AS value FROM d WINDOW v AS (PARTITION BY vec_id)""",
    "rank_scores": _PAIRS + " SELECT request_id, pos, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos)::INT AS rank FROM p",
    "spearman": _PAIRS + """, r AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) - row_number() OVER (PARTITION BY request_id ORDER BY n_chars DESC, pos) AS d FROM p)
        SELECT request_id, count(*) AS n, round(CASE WHEN count(*) > 1 THEN 1 - 6 * sum((d * d)::DOUBLE) / (count(*) * (count(*) * count(*) - 1)) END, 6) AS rho FROM r GROUP BY 1""",
    "score_min_max": _PAIRS + " SELECT request_id, round(min(score)::DOUBLE, 5) AS low, round(max(score)::DOUBLE, 5) AS high FROM p GROUP BY 1",
    "codec_roundtrip": "SELECT vec_id, len(embedding)::INT AS dimensions, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[len(embedding)]::DOUBLE, 5) AS last FROM embeddings WHERE label IS NOT NULL",
    "codec_sizes": "SELECT label, sum(4 * len(embedding))::BIGINT AS payload_bytes FROM embeddings GROUP BY 1",
    "embed_stub": "SELECT doc_id, 32::INT AS dimensions, 1.0::DOUBLE AS norm FROM documents",
    "quantized_first": "SELECT 'm' || p_size AS model, CASE WHEN bool_or(p_partkey % 5 = 0) THEN 'model_i8.onnx' ELSE 'model.onnx' END AS file FROM part GROUP BY 1",
}
