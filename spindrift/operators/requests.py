"""Parsing and validating request bodies: one projection gives status and error, first failing rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "array<struct<type:string,text:string,image_url:struct<url:string>>>"


def parse_input(raw: Column) -> Column:
    """The input union: a non-empty string array, else a non-empty string, else a non-empty array of parts; anything else is null.

    Returns an array with one struct(type, text, url) per item. Parts are told apart by their ``type``. A string array must hold
    strings only: the element types are checked, because a cast would also take numbers.
    """
    kind = F.schema_of_variant(F.try_parse_json(raw))
    item = lambda t, text, url: F.struct(F.lit(t).alias("type"), text.alias("text"), url.alias("url"))
    none = F.lit(None).cast("string")
    strings = F.from_json(raw, "array<string>")
    text = F.try_variant_get(F.try_parse_json(raw), "$", "string")
    parts = F.from_json(raw, PART)
    as_parts = F.transform(parts, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), p["image_url"]["url"].alias("url")))
    good = F.forall(parts, lambda p: p["type"].isin("text", "image_url"))
    return (F.when((kind == "ARRAY<STRING>") & (F.size(strings) > 0), F.transform(strings, lambda s: item("text", s, none)))
            .when((kind == "STRING") & (text != ""), F.array(item("text", text, none)))
            .when(kind.startswith("ARRAY<OBJECT") & (F.size(parts) > 0) & good, as_parts))


def mime_of(part: Column) -> Column:
    """text/plain for text, the declared type of a data URI, else null."""
    return F.when(part["type"] == "text", "text/plain").otherwise(F.nullif(F.regexp_extract(part["url"], r"^data:([^;,]*)[;,]", 1), F.lit("")))


def mime_violations(parts: Column, supported: Column) -> Column:
    """Indexes of the items whose type the model does not take."""
    bad = F.filter(F.transform(parts, lambda p, k: F.struct(k.alias("k"), F.coalesce(F.array_contains(supported, mime_of(p)), F.lit(False)).alias("ok"))), lambda x: ~x["ok"])
    return F.transform(bad, lambda x: x["k"])


def first_failure(rules: list[tuple[Column, int, str]]) -> Column:
    """struct(status, error) of the first rule whose condition holds; 200 and null if none does."""
    status, error = F.lit(200), F.lit(None).cast("string")
    for condition, code, message in reversed(rules):
        failed = F.coalesce(condition, F.lit(False))
        status, error = F.when(failed, code).otherwise(status), F.when(failed, message).otherwise(error)
    return F.struct(status.alias("status"), error.alias("error"))


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def validate_embed(bodies: DataFrame, models: DataFrame, *, body: str = "body", provider: bool = True) -> DataFrame:
    """Adds status, error, items. ``models``: name, mime array<string>."""
    parsed = bodies.withColumn("_v", F.try_parse_json(body)).withColumn("_model", F.try_variant_get("_v", "$.model", "string"))
    parsed = parsed.withColumn("items", parse_input(_raw_input(F.col(body))))
    joined = parsed.join(models.select(F.col("name").alias("_model"), F.col("mime").alias("_mime")), "_model", "left")
    rules = [(F.lit(not provider), 503, "embedding not available"), (F.col("_v").isNull(), 400, "decoding request"), (_blank(F.col("_model")), 400, "model is required"),
             (F.col("_mime").isNull(), 404, "model not found"), (F.col("items").isNull(), 400, "input must be a string, an array of strings or an array of content parts"),
             (F.size(mime_violations(F.col("items"), F.col("_mime"))) > 0, 400, "unsupported content type")]
    return joined.withColumn("_f", first_failure(rules)).select(*bodies.columns, F.col("_f.status").alias("status"), F.col("_f.error").alias("error"), F.when(F.col("_f.status") == 200, F.col("items")).alias("items"))


def _raw_input(body: Column) -> Column:
    """The JSON text of the ``input`` field; strings keep their quotes."""
    return F.to_json(F.try_variant_get(F.try_parse_json(body), "$.input", "variant"))


def validate_chunk(bodies: DataFrame, *, body: str = "body") -> DataFrame:
    v = F.try_parse_json(body)
    rules = [(v.isNull(), 400, "decoding request"), (_blank(F.try_variant_get(v, "$.text", "string")), 400, "text is required")]
    return bodies.withColumn("_f", first_failure(rules)).select(*bodies.columns, "_f.status", "_f.error")


def validate_rerank(bodies: DataFrame, models: DataFrame, *, body: str = "body", available: bool = True) -> DataFrame:
    """``models``: name. The service answers 503 before it reads the body if there is no model at all."""
    v = F.try_parse_json(body)
    parsed = bodies.withColumn("_model", F.try_variant_get(v, "$.model", "string"))
    joined = parsed.join(models.select(F.col("name").alias("_model"), F.lit(True).alias("_known")), "_model", "left")
    prompts = F.try_variant_get(v, "$.prompts", "array<string>")
    rules = [(F.lit(not available), 503, "reranking not available"), (v.isNull(), 400, "decoding request"), (_blank(F.col("_model")), 400, "model is required"),
             (_blank(F.try_variant_get(v, "$.query", "string")), 400, "query is required"), (prompts.isNull() | (F.size(prompts) == 0), 400, "prompts are required"), (F.col("_known").isNull(), 404, "model not found")]
    return joined.withColumn("_f", first_failure(rules)).select(*bodies.columns, "_f.status", "_f.error")


def chunk_options(body: Column, compat: bool = False) -> Column:
    """The chunk config of a request with defaults; ``compat`` drops overlap and separator as the service does. Zero is unset."""
    v = F.try_parse_json(body)
    number = lambda name, default: F.coalesce(F.nullif(F.try_variant_get(v, f"$.config.{name}", "int"), F.lit(0)), F.lit(default))
    overlap = F.lit(50) if compat else F.when(number("overlap_tokens", 50) < 0, 50).otherwise(number("overlap_tokens", 50))
    separator = F.lit("\n\n") if compat else F.coalesce(F.nullif(F.try_variant_get(v, "$.config.separator", "string"), F.lit("")), F.lit("\n\n"))
    return F.struct(F.coalesce(F.nullif(F.try_variant_get(v, "$.config.model", "string"), F.lit("")), F.lit("fixed-bert-tokenizer")).alias("model"), number("target_tokens", 500).alias("target_tokens"),
                    overlap.alias("overlap_tokens"), separator.alias("separator"), number("max_chunks", 50).alias("max_chunks"),
                    F.coalesce(F.nullif(F.try_variant_get(v, "$.config.threshold", "double"), F.lit(0.0)), F.lit(0.5)).alias("threshold"))


def request_model(body: Column) -> Column:
    """The model of any request: the top-level field, else the chunk config's, else empty."""
    v = F.try_parse_json(body)
    return F.coalesce(F.try_variant_get(v, "$.model", "string"), F.try_variant_get(v, "$.config.model", "string"), F.lit(""))


def wants_json(accept: Column) -> Column:
    """JSON only for exactly this accept header; everything else gets the binary stream."""
    return F.coalesce(accept == "application/json", F.lit(False))
