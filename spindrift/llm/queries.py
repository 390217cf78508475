"""The ten operators and the pipeline, bound to the tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.session import ship

from .line_dedup import BLOCK_TAG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mixture_targets():
    """Even sources, English at half, forms of text other than prose held down; half of the tokens."""
    from .mixing import Targets

    return Targets(
        source={f"src{k}": 0.95 / 20 for k in range(20)} | {"*": 0.05},
        lang={"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.15, "*": 0.01},
        topic={"prose": 0.9, "table": 0.05, "symbols": 0.03, "shout": 0.02},
        budget=0.5)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), mixture_targets())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_render import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data, fit_tagger

    return find_personal_data(table(spark, sf_dir, "documents"), fit_tagger())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import WORDS, corpus_words, fit_forest, labelled_findings, scan_secrets

    docs = table(spark, sf_dir, "documents")
    words = WORDS + corpus_words(docs)
    return scan_secrets(docs, fit_forest(labelled_findings(spark), words=words), words=words)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_html": op4_html,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_minhash": op8_minhash,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents),
        g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
        c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
        SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op8_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.both >= 85 * (na.size + nb.size - p.both)),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
        c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op10_line_dedup": r"""
        WITH t AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'),
                '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), 'BLOCK', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t\r\f]+', ' ', 'g') AS text FROM pages),
        p AS (SELECT page_id, host, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM t),
        h AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
        e AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p),
        b AS (SELECT e.host, list(e.line) AS drop FROM (SELECT host, line, count(*) AS n FROM e GROUP BY 1, 2) e JOIN h USING (host) WHERE e.n >= 2 AND e.n > h.pages * 0.3 GROUP BY 1),
        k AS (SELECT p.page_id, p.host, p.lines, list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.drop, x), false)) AS kept FROM p LEFT JOIN b USING (host))
        SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k""".replace("BLOCK", BLOCK_TAG),
}
