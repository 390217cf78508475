"""Chunking queries over ``documents`` with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import let, token_estimate
from spindrift.functions.models import SentenceBoundaries, boundary_udf
from spindrift.operators.chunking import ChunkConfig, chunk_by_model, chunk_fixed, chunk_neural
from spindrift.sources.tables import table

#: No truncation: only ``chunk_fixed_max_chunks`` is about it.
ALL = 2**31 - 1
CONFIGS = {
    "chunk_fixed_len4": ChunkConfig(max_chunks=ALL),
    "chunk_fixed_newline_sep": ChunkConfig(target_tokens=120, overlap_tokens=10, separator="\n", max_chunks=ALL),
    "chunk_fixed_no_overlap": ChunkConfig(target_tokens=80, overlap_tokens=0, max_chunks=ALL),
    "chunk_fixed_max_chunks": ChunkConfig(target_tokens=60, overlap_tokens=5, max_chunks=3),
    "chunk_sentence_fallback": ChunkConfig(target_tokens=40, overlap_tokens=4, separator="; ", max_chunks=ALL),
}
NEURAL = {"chunk_neural_cut": ChunkConfig(target_tokens=0, threshold=0.4, max_chunks=ALL), "chunk_neural_aggregate": ChunkConfig(target_tokens=100, threshold=0.4, max_chunks=ALL)}


def with_entities(docs: DataFrame) -> DataFrame:
    """Stand-in classifier output: an entity at every sentence end, labelled and scored by its place."""
    parts = F.split("text", r"\. ", -1)
    ends = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(p) + 2)))
    inner = let(ends, lambda found: F.slice(found, 2, F.greatest(F.size(found) - 2, F.lit(0))))
    return docs.withColumn("entities", F.transform(inner, lambda e, k: F.struct(
        F.element_at(F.array(F.lit("separator"), F.lit("B-SEPARATOR"), F.lit("O")), (k % 3 + 1).cast("int")).alias("entity"), ((e * 7919 % 1000) / 1000).alias("score"), e.alias("end"))))


def _fixed(name: str):
    return lambda spark, sf_dir: chunk_fixed(table(spark, sf_dir, "documents"), CONFIGS[name]).drop("text")


def _neural(name: str):
    return lambda spark, sf_dir: chunk_neural(with_entities(table(spark, sf_dir, "documents")), NEURAL[name]).drop("text")


def chunk_boundary_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries from a model behind a vectorised UDF."""
    found = table(spark, sf_dir, "documents").withColumn("entities", boundary_udf(SentenceBoundaries)(F.col("text")))
    return chunk_neural(found, NEURAL["chunk_neural_cut"]).drop("text")


def chunk_model_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.sql("SELECT * FROM VALUES ('mini-boundary') AS t(name)")
    asked = with_entities(table(spark, sf_dir, "documents")).withColumn("model", F.expr("CASE doc_id % 4 WHEN 0 THEN 'mini-boundary' WHEN 1 THEN 'fixed' WHEN 2 THEN 'fixed-bpe-tokenizer' ELSE 'missing-model' END"))
    out = chunk_by_model(asked, models, _DISPATCH)
    return out.groupBy("requested_model", "model_used").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))


def chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: chunks per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    chunks = chunk_fixed(docs.withColumn("_k", F.struct("doc_id", "lang")), ChunkConfig(max_chunks=ALL), id_col="_k")
    return chunks.groupBy(F.col("_k.lang").alias("lang")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("_k.doc_id").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("chunk_id").cast("int").alias("max_chunk_id"))


def token_estimate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("n_tokens"))


QUERIES = {n: _fixed(n) for n in CONFIGS} | {n: _neural(n) for n in NEURAL} | {
    "chunk_boundary_model": chunk_boundary_model, "chunk_model_dispatch": chunk_model_dispatch, "chunk_stats_by_lang": chunk_stats_by_lang, "token_estimate": token_estimate_query}

_WHITE = r"[ \t\n\x0B\f\r\x{0085}\p{Z}]"
_WHITE_HEX = "20|09|0A|0B|0C|0D|C285|C2A0|E19A80|E2808[0-9A]|E280A8|E280A9|E280AF|E2819F|E38080"


def _trim_hex(x: str) -> str:
    return f"regexp_replace({x}, '^({_WHITE_HEX})+|({_WHITE_HEX})+$', '', 'g')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


def fixed_sql(c: ChunkConfig, docs: str = "documents", key: str = "doc_id") -> str:
    """Rows of (key, chunk list) by a list fold."""
    sep, gap, size = c.separator.replace("'", "''"), c.separator.encode().hex().upper(), len(c.separator.encode())
    room, done = f"len(a.out) < {c.max_chunks}", _trim_hex("a.cur")
    full = f"(len(a.out) < {c.max_chunks} AND a.tokens > 0 AND a.tokens + length(x.cur) // 8 > {c.target_tokens})"
    prev = f"(CASE WHEN {full} AND {done} <> '' THEN {done} ELSE a.prev END)"
    overlap = f"right({prev}, {8 * c.overlap_tokens})" if c.overlap_tokens else "''"
    kept = f"(CASE WHEN {full} THEN (CASE WHEN {overlap} <> '' THEN {overlap} || '20' ELSE '' END) ELSE a.cur END)"
    zero = "{'cur': '', 'start': 0::BIGINT, 'tokens': 0::BIGINT, 'prev': '', 'out': []::STRUCT(text VARCHAR, start_char BIGINT, end_char BIGINT)[]}"
    step = f"""{{
        'cur': CASE WHEN NOT {room} THEN a.cur ELSE {kept} || (CASE WHEN {kept} <> '' THEN '{gap}' ELSE '' END) || x.cur END,
        'start': CASE WHEN {full} THEN a.start + length({done}) // 2 + {size} ELSE a.start END,
        'tokens': (CASE WHEN {full} THEN length({overlap}) // 8 ELSE a.tokens END) + length(x.cur) // 8,
        'prev': {prev},
        'out': CASE WHEN {full} AND {done} <> '' THEN list_append(a.out, {{'text': {done}, 'start_char': a.start, 'end_char': a.start + length({done}) // 2}}) ELSE a.out END}}"""
    return f"""
        WITH parted AS (
            SELECT {key} AS k, text, CASE WHEN len(string_split(text, '{sep}')) > 1 THEN string_split(text, '{sep}')
                WHEN len(string_split(text, chr(10))) > 1 THEN string_split(text, chr(10))
                ELSE list_transform(string_split(text, '. '), lambda s, i: CASE WHEN i < len(string_split(text, '. ')) THEN s || '.' ELSE s END) END AS parts
            FROM {docs} WHERE text <> ''),
        cleaned AS (SELECT k, text, list_filter(list_transform(parts, lambda s: {_trim('s')}), lambda s: s <> '') AS parts FROM parted),
        folded AS (
            SELECT k, text, list_reduce(
                list_transform(parts, lambda s: {{'cur': hex(encode(s)), 'start': 0::BIGINT, 'tokens': 0::BIGINT, 'prev': '', 'out': []::STRUCT(text VARCHAR, start_char BIGINT, end_char BIGINT)[]}}),
                lambda a, x: {step}, {zero}) AS a FROM cleaned),
        closed AS (
            SELECT k, text, CASE WHEN {done} <> '' AND {room} THEN list_append(a.out, {{'text': {done}, 'start_char': a.start, 'end_char': a.start + length({done}) // 2}}) ELSE a.out END AS out FROM folded),
        chunks AS (
            SELECT k, CASE WHEN len(out) = 0 THEN [{{'text': hex(encode({_trim('text')})), 'start_char': 0::BIGINT, 'end_char': strlen(text)::BIGINT}}] ELSE out END AS out FROM closed)"""


_ROWS = """,
        numbered AS (SELECT k, unnest(generate_series(1, len(out))) AS i, out FROM chunks)"""


def _rows(head: str) -> str:
    return head + _ROWS + """
        SELECT k AS doc_id, (i - 1)::INT AS chunk_id, out[i].start_char AS start_char, out[i].end_char AS end_char,
            (length(out[i].text) // 8)::BIGINT AS n_tokens, md5(unhex(out[i].text)) AS chunk_md5 FROM numbered"""


def neural_sql(c: ChunkConfig) -> str:
    join = f"""list_reduce(
            list_transform(pieces, lambda p: {{'out': [p], 'tokens': (length(p.text) // 8)::BIGINT}}),
            lambda a, x: CASE WHEN a.tokens > 0 AND a.tokens + x.tokens > {c.target_tokens}
                THEN {{'out': list_append(a.out, x.out[1]), 'tokens': x.tokens}}
                ELSE {{'out': list_append(a.out[1:len(a.out) - 1], {{'text': a.out[len(a.out)].text || '0A0A' || x.out[1].text, 'start_char': a.out[len(a.out)].start_char, 'end_char': x.out[1].end_char}}), 'tokens': a.tokens + x.tokens}} END).out"""
    return f"""
        WITH s AS (SELECT doc_id AS k, text, hex(encode(text)) AS raw, string_split(text, '. ') AS parts FROM documents WHERE text <> ''),
        e AS (SELECT k, raw, length(raw) // 2 AS size, list_transform(generate_series(1, len(parts) - 1), lambda i: list_sum(list_transform(parts[1:i], lambda p: strlen(p) + 2))::BIGINT) AS ends FROM s),
        n AS (SELECT k, raw, size, list_sort(list_distinct(list_filter(list_filter(ends, lambda p, i: (i - 1) % 3 < 2 AND (p * 7919 % 1000) / 1000 >= {c.threshold}), lambda p: p > 0 AND p <= size))) AS cuts FROM e),
        z AS (SELECT k, raw, size, list_prepend(0::BIGINT, cuts) AS starts, list_append(cuts, size::BIGINT) AS stops FROM n),
        p AS (SELECT k, raw, size, list_filter(list_transform(starts, lambda b, i: {{'text': {_trim_hex('substr(raw, b * 2 + 1, (stops[i] - b) * 2)')}, 'start_char': b, 'end_char': stops[i]}}), lambda q: q.text <> '') AS pieces FROM z),
        w AS (SELECT k, CASE WHEN len(pieces) = 0 THEN [{{'text': {_trim_hex('raw')}, 'start_char': 0::BIGINT, 'end_char': size::BIGINT}}] ELSE pieces END AS pieces FROM p),
        chunks AS (SELECT k, (CASE WHEN len(pieces) > 1 THEN {join if c.target_tokens > 0 else 'pieces'} ELSE pieces END)[1:{c.max_chunks}] AS out FROM w)"""


_DISPATCH = ChunkConfig(target_tokens=100, threshold=0.4, max_chunks=ALL)
ORACLE_SQL = {n: _rows(fixed_sql(c)) for n, c in CONFIGS.items()} | {n: _rows(neural_sql(c)) for n, c in NEURAL.items()} | {
    "chunk_boundary_model": _rows(neural_sql(NEURAL["chunk_neural_cut"])),
    "token_estimate": "SELECT doc_id, (strlen(text) // 4)::BIGINT AS n_tokens FROM documents",
    "chunk_stats_by_lang": fixed_sql(ChunkConfig(max_chunks=ALL), key="{'d': doc_id, 'l': lang}") + _ROWS + """
        SELECT k.l AS lang, count(*) AS n_chunks, count(DISTINCT k.d) AS n_docs, sum(length(out[i].text) // 8)::BIGINT AS n_tokens, (max(i) - 1)::INT AS max_chunk_id FROM numbered GROUP BY 1""",
    "chunk_model_dispatch": "WITH f AS (" + fixed_sql(_DISPATCH) + " SELECT k, out FROM chunks), g AS (" + neural_sql(_DISPATCH) + """ SELECT k, out FROM chunks),
        u AS (SELECT CASE k % 4 WHEN 1 THEN 'fixed' WHEN 2 THEN 'fixed-bpe-tokenizer' ELSE 'missing-model' END AS requested_model,
                CASE k % 4 WHEN 2 THEN 'fixed-bpe-tokenizer' ELSE 'fixed-bert-tokenizer' END AS model_used, out FROM f WHERE k % 4 <> 0
              UNION ALL SELECT 'mini-boundary', 'mini-boundary', out FROM g WHERE k % 4 = 0)
        SELECT requested_model, model_used, sum(len(out))::BIGINT AS n_chunks, sum(list_sum(list_transform(out, lambda c: length(c.text) // 8)))::BIGINT AS n_tokens FROM u GROUP BY 1, 2""",
}
