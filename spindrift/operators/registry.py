"""Model registry: references, variants, manifests, download plans, listings, specs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from spindrift.operators.requests import first_failure

#: Variant ids and their files; fixed values.
VARIANT_FILES = {"f32": "model.onnx", "f16": "model_f16.onnx", "bf16": "model_bf16.onnx", "i8": "model_i8.onnx", "i8-st": "model_i8-st.onnx", "i4": "model_i4.onnx"}
TYPES = ("embedder", "chunker", "reranker")


def model_type(text: Column) -> Column:
    """Singular or plural in any case to the type, else null."""
    name = F.lower(text)
    return F.when(F.regexp_replace(name, "s$", "").isin(*TYPES), F.regexp_replace(name, "s$", ""))


def model_ref(ref: Column) -> Column:
    """struct(name, variant): the variant is a known suffix after a dash, else empty."""
    pattern = r"^(.*)-(f32|f16|bf16|i8-st|i8|i4)$"
    variant = F.regexp_extract(ref, pattern, 2)
    return F.struct(F.when(variant == "", ref).otherwise(F.regexp_extract(ref, pattern, 1)).alias("name"), variant.alias("variant"))


def hub_ref(ref: Column) -> Column:
    """The repository of an ``hf:`` reference, else null."""
    return F.when(ref.startswith("hf:"), F.substring(ref, 4, 1 << 20))


def variant_file(variant: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in VARIANT_FILES.items() for x in kv]), variant)


def registry_name(name: Column, variant: Column) -> Column:
    return F.when(F.coalesce(variant, F.lit("")) == "", name).otherwise(F.concat_ws("-", name, variant))


def discover_variants(files: DataFrame) -> DataFrame:
    """(model, type, file) to (model, type, variant, registry_name). The base file counts twice: as the default and as ``f32``."""
    by_file = F.create_map(*[F.lit(x) for k, v in VARIANT_FILES.items() for x in (v, k)])
    known = files.withColumn("variant", F.element_at(by_file, F.col("file"))).where(F.col("variant").isNotNull())
    each = F.when(F.col("variant") == "f32", F.array(F.lit(""), F.lit("f32"))).otherwise(F.array("variant"))
    return known.select("model", "type", F.explode(each).alias("variant")).distinct().withColumn("registry_name", registry_name(F.col("model"), F.col("variant")))


def list_models(models: DataFrame) -> DataFrame:
    """One row of three sorted name lists, empty ones included (``models``: type, name)."""
    pick = lambda t: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("type") == t, F.col("name")))))
    return models.agg(*[pick(t).alias(f"{t}s") for t in TYPES])


def readiness(models: DataFrame) -> DataFrame:
    """status 503 while no model is there."""
    return list_models(models).select(sum(F.size(f"{t}s") for t in TYPES).alias("models")).withColumn("status", F.when(F.col("models") > 0, 200).otherwise(503))


def validate_manifest(m: Column) -> Column:
    """struct(status, error) of a parsed manifest: 200, or 400 with the first failing rule."""
    files, variants = m["files"], F.map_entries(m["variants"])
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    bad_digest = lambda f: ~F.coalesce(f["digest"], F.lit("")).startswith("sha256:")
    return first_failure([
        (m.isNull(), 400, "parsing manifest"), (F.coalesce(m["schemaVersion"], F.lit(0)) != 1, 400, "unsupported schema version"), (blank(m["name"]), 400, "name is required"), (blank(m["type"]), 400, "type is required"),
        (model_type(m["type"]).isNull(), 400, "invalid type"), (files.isNull() | (F.size(files) == 0), 400, "at least one file is required"), (F.exists(files, lambda f: blank(f["name"])), 400, "file name is required"),
        (F.exists(files, lambda f: blank(f["digest"])), 400, "file digest is required"), (F.exists(files, bad_digest), 400, "digest must start with sha256:"),
        (~F.exists(files, lambda f: f["name"] == "model.onnx"), 400, "model.onnx is required"), (F.exists(variants, lambda v: ~v["key"].isin(*VARIANT_FILES)), 400, "unknown variant"),
        (F.exists(variants, lambda v: blank(v["value"]["name"]) | blank(v["value"]["digest"])), 400, "variant needs name and digest")])


def download_plan(manifests: DataFrame, wanted: Column) -> DataFrame:
    """(model, file, size, digest) to fetch: support files always, the base file for f32, the wanted variants that exist."""
    files = manifests.select("name", wanted.alias("wanted"), F.explode("files").alias("f"))
    base = files.where((F.col("f.name") != "model.onnx") | F.array_contains("wanted", "f32")).select(F.col("name").alias("model"), "f.name", "f.size", "f.digest")
    variants = manifests.select("name", wanted.alias("wanted"), F.explode("variants").alias("variant", "f")).where(F.array_contains("wanted", F.col("variant")))
    return base.unionByName(variants.select(F.col("name").alias("model"), "f.name", "f.size", "f.digest")).withColumnRenamed("name", "file")


def verify_blobs(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, content) against (path, digest, size): ok, size mismatch, hash mismatch or missing; the size is checked first."""
    have = files.select("path", F.octet_length("content").alias("_size"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("_digest"))
    state = F.when(F.col("_digest").isNull(), "missing").when(F.col("size").isNotNull() & (F.col("_size") != F.col("size")), "size mismatch").when(F.col("_digest") != F.col("digest"), "hash mismatch").otherwise("ok")
    return expected.join(have, "path", "left").select(*expected.columns, state.alias("state"))


def hub_files(listing: DataFrame, variant: str = "f32") -> DataFrame:
    """Files to pull from a repository listing (repo, path): of each tokenizer or config file the first path, all weights of the variant."""
    support = ["tokenizer.json", "tokenizer_config.json", "config.json", "special_tokens_map.json", "vocab.txt"]
    base = F.element_at(F.split("path", "/"), -1)
    stem = VARIANT_FILES[variant]
    first = listing.where(base.isin(support)).groupBy("repo", base.alias("file")).agg(F.min("path").alias("path"))
    weights = listing.where(base.isin(stem, f"{stem}_data")).select("repo", base.alias("file"), "path")
    return first.unionByName(weights)


def hub_variants(listing: DataFrame) -> DataFrame:
    by_file = F.create_map(*[F.lit(x) for k, v in VARIANT_FILES.items() for x in (v, k)])
    found = listing.withColumn("variant", F.element_at(by_file, F.element_at(F.split("path", "/"), -1)))
    return found.groupBy("repo").agg(F.array_sort(F.collect_set("variant")).alias("variants"))


def format_bytes(size: Column) -> Column:
    """``512 B``, ``1.5 KB`` up to EB in steps of 1024."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", size / float(1024**k)), F.lit(f" {unit}B"))).otherwise(out)
    return out


def ellipsis(text: Column, width: int = 50) -> Column:
    """At most ``width`` bytes: longer text keeps width - 3 and three points."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, width - 3).cast("string"))
    return F.when(F.octet_length(text) > width, F.concat(cut, F.lit("..."))).otherwise(text)


def local_sizes(files: DataFrame) -> DataFrame:
    """Shown size per model (model, file, size): the base file twice, as default and as f32, then variants and support files."""
    known = list(VARIANT_FILES.values())
    counted = F.when(F.col("file") == "model.onnx", F.col("size") * 2).when(F.col("file").isin(known) | ~F.col("file").endswith(".onnx"), F.col("size")).otherwise(0)
    return files.groupBy("model").agg(F.sum(counted).alias("size"))


def multimodal_models(files: DataFrame) -> DataFrame:
    """Models that have both a visual and a text part (model, file)."""
    return files.where(F.col("file").isin("visual_model.onnx", "text_model.onnx")).groupBy("model").agg(F.count_distinct("file").alias("_n")).where("_n = 2").select("model")


def active_routes(routes: DataFrame, pools: DataFrame) -> DataFrame:
    """(route, namespace, pool refs) active iff each referenced pool is in the namespace; no reference means active."""
    refs = routes.select("route", "namespace", F.explode_outer("pools").alias("pool"))
    there = pools.select("namespace", F.col("name").alias("pool"), F.lit(True).alias("_there"))
    return refs.join(there, ["namespace", "pool"], "left").groupBy("namespace", "route").agg(F.every(F.col("pool").isNull() | F.col("_there").isNotNull()).alias("active"))


def pool_phase(stateful_set: Column, desired: Column, ready: Column) -> Column:
    return F.when(~stateful_set, "Pending").when(ready == desired, "Running").when(ready > 0, "Scaling").otherwise("Pending")


def tpu_count(topology: Column) -> Column:
    """``RxC`` gives the product; anything else 4."""
    a, b = (F.regexp_extract(F.coalesce(topology, F.lit("")), r"^([0-9]{1,4})x([0-9]{1,4})$", k).try_cast("int") for k in (1, 2))
    return F.coalesce(a * b, F.lit(4))


def preload_groups(models: DataFrame) -> DataFrame:
    """(pool, name, variant) to one pull command line per pool; groups by variant (f32 unless set), all sorted."""
    variant = F.coalesce(F.nullif(F.col("variant"), F.lit("")), F.lit("f32"))
    groups = models.groupBy("pool", variant.alias("variant")).agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))
    lines = groups.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("variant", "names"))).alias("g"))
    return lines.select("pool", F.array_join(F.transform("g", lambda x: F.concat(F.lit("pull --variants "), x["variant"], F.lit(" "), x["names"])), " && ").alias("command"))


def template_hash(spec: Column) -> Column:
    """The first eight bytes of the SHA-256 of the JSON text, in hexadecimal."""
    return F.substring(F.sha2(F.to_json(spec), 256), 1, 16)


def merge_config(user: Column, defaults: Column) -> Column:
    """Maps of settings; the user's win."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(user, k)), user)


#: What ``route_errors`` and ``pool_errors`` read of a spec; fields that are absent in the JSON are null.
ROUTE_SPEC = (
    "match struct<operations:array<string>,models:array<string>,headers:map<string,struct<exact:string,prefix:string,regex:string>>,"
    "timeWindow:struct<start:string,end:string,days:array<int>>>,route array<struct<pool:string,weight:int,condition:struct<queueDepth:string>>>,"
    "fallback struct<action:string,redirectPool:string>,rateLimiting struct<requestsPerSecond:int,burstSize:int>,"
    "retry struct<attempts:int,retryOn:array<string>>")
POOL_SPEC = "hardware struct<accelerator:string,spot:boolean>,gke struct<autopilot:boolean,autopilotComputeClass:string>,limits map<string,string>,replicas struct<min:int,max:int>"
#: Fixed values.
COMPUTE_CLASSES = ["Accelerator", "Balanced", "Performance", "Scale-Out", "autopilot", "autopilot-spot"]
RETRY_ON = ["5xx", "reset", "connect-failure", "retriable-4xx", "refused-stream", "cancelled", "deadline-exceeded", "resource-exhausted"]
GPU_LIMITS = ["nvidia.com/gpu", "cloud.google.com/gke-gpu"]


@F.pandas_udf(ArrayType(BooleanType()))
def _compile(patterns: pd.Series) -> pd.Series:
    def fine(pattern: str | None) -> bool:
        try:
            re.compile(pattern or "")
        except re.error:
            return False
        return True

    return patterns.map(lambda some: None if some is None else [fine(p) for p in some])


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _messages(checks: list[tuple[Column, str]]) -> Column:
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), message) for broken, message in checks])
    return F.filter(found, lambda message: message.isNotNull())


def route_errors(r: Column) -> Column:
    """All violations of a route spec (``ROUTE_SPEC``), as an array of messages.

    Whether a pattern compiles is the one check that no expression can make; it takes a vectorised UDF over control data
    and follows Python's pattern syntax. Null specs have no destination.
    """
    match, d, fallback, limit, retry = r["match"], r["route"], r["fallback"], r["rateLimiting"], r["retry"]
    clock = r"^([01]?[0-9]|2[0-3]):[0-5][0-9]$"
    window = match["timeWindow"]
    unconditional = F.transform(F.filter(d, lambda x: x["condition"].isNull()), lambda x: x["pool"])
    matchers = F.map_values(match["headers"])
    globs = F.transform(F.filter(match["models"], lambda m: m.contains("*")), lambda m: F.concat(F.lit("^"), F.replace(m, F.lit("*"), F.lit(".*")), F.lit("$")))
    broken = lambda patterns: F.exists(_compile(patterns), lambda fine: ~fine)
    return _messages([
        (d.isNull() | (F.size(d) == 0), "at least one destination is required"),
        (F.exists(d, lambda x: _blank(x["pool"])), "pool is required"),
        (F.size(unconditional) != F.size(F.array_distinct(unconditional)), "duplicate unconditional pool"),
        (F.exists(d, lambda x: (x["weight"] < 0) | (x["weight"] > 100)), "weight must be 0-100"),
        (F.exists(match["operations"], lambda o: ~o.isin("embed", "chunk", "rerank")), "unknown operation"),
        (F.exists(match["models"], lambda m: m == ""), "empty model pattern"),
        (broken(globs), "model pattern does not compile"),
        (F.exists(F.array(window["start"], window["end"]), lambda t: ~_blank(t) & ~t.rlike(clock)), "time must be HH:MM"),
        (F.exists(window["days"], lambda x: (x < 0) | (x > 6)), "day must be 0-6"),
        (F.exists(F.map_keys(match["headers"]), lambda h: h == ""), "empty header name"),
        (F.exists(matchers, lambda m: _blank(m["exact"]) & _blank(m["prefix"]) & _blank(m["regex"])), "header needs exact, prefix or regex"),
        (broken(F.transform(matchers, lambda m: m["regex"])), "header regex does not compile"),
        (fallback.isNotNull() & ~F.coalesce(fallback["action"], F.lit("")).isin("queue", "reject", "redirect"), "unknown fallback action"),
        ((fallback["action"] == "redirect") & _blank(fallback["redirectPool"]), "redirectPool is required"),
        (limit["requestsPerSecond"] <= 0, "requestsPerSecond must be positive"),
        (limit["burstSize"] < 0, "burstSize must not be negative"),
        (retry["attempts"] < 0, "attempts must not be negative"),
        (F.exists(retry["retryOn"], lambda c: ~c.isin(RETRY_ON)), "unknown retry condition")])


def _pool_checks(p: Column) -> tuple[Column, list[tuple[Column, str]], list[tuple[Column, str]]]:
    """Whether autopilot is on, and what both validators ask of the compute class and of the replicas."""
    gke, replicas = p["gke"], p["replicas"]
    auto, kind = F.coalesce(gke["autopilot"], F.lit(False)), gke["autopilotComputeClass"]
    classes = [(~_blank(kind) & ~kind.isin(COMPUTE_CLASSES), "unknown compute class"), (~_blank(kind) & ~auto, "compute class requires autopilot")]
    counts = [(replicas["min"] < 0, "min must not be negative"), (replicas["max"] <= 0, "max must be positive"), (replicas["max"] < replicas["min"], "max must not be below min")]
    return auto, classes, counts


def pool_errors(p: Column, old: Column | None = None) -> Column:
    """All violations of a pool spec (``POOL_SPEC``) at admission; with ``old`` also the fields that must not change."""
    gke, (auto, classes, counts) = p["gke"], _pool_checks(p)
    gpu = F.exists(F.map_keys(p["limits"]), lambda k: k.isin(GPU_LIMITS))
    checks = [*classes, ((gke["autopilotComputeClass"] == "Accelerator") & ~F.coalesce(gpu, F.lit(False)), "Accelerator requires a GPU"),
              (auto & F.coalesce(p["hardware"]["spot"], F.lit(False)), "spot conflicts with autopilot"), *counts]
    if old is not None:
        was = old["gke"]
        was_auto = F.coalesce(was["autopilot"], F.lit(False))
        both = gke.isNotNull() & was.isNotNull()
        same_class = F.coalesce(gke["autopilotComputeClass"], F.lit("")) == F.coalesce(was["autopilotComputeClass"], F.lit(""))
        checks += [(both & (auto != was_auto), "autopilot is immutable"), (both & auto & ~same_class, "compute class is immutable"),
                   (gke.isNull() & was_auto, "gke must not be removed")]
    return _messages(checks)


def controller_pool_errors(p: Column) -> Column:
    """All violations that the controller sees in a pool spec: spot is allowed for TPU pools, a GPU is not asked for."""
    auto, classes, counts = _pool_checks(p)
    tpu = F.coalesce(p["hardware"]["accelerator"].contains("tpu"), F.lit(False))
    return _messages([*classes, (auto & F.coalesce(p["hardware"]["spot"], F.lit(False)) & ~tpu, "spot conflicts with autopilot"), *counts])


def remote_list(index: DataFrame, wanted_type: str | None = None) -> DataFrame:
    """Models of an index, of one type if given, with the description cut to fifty bytes and the size as shown."""
    some = index.where(F.col("type") == wanted_type) if wanted_type else index
    return some.select("name", "type", ellipsis(F.col("description")).alias("description"), format_bytes(F.col("size")).alias("size"))


def preload_outcome(attempts: DataFrame, node: str) -> DataFrame:
    """Per node: how many preloads worked; preloading fails only if there were some and all failed (``attempts``: node, ok)."""
    done = attempts.groupBy(node).agg(F.count(F.lit(1)).alias("asked"), F.count_if("ok").alias("loaded"))
    return done.withColumn("failed", F.col("loaded") == 0)


def unload(loaded: DataFrame, models: list[str]) -> DataFrame:
    """The residency table after unloading; pinned models stay (``loaded``: model, pinned)."""
    return loaded.where(F.col("pinned") | ~F.col("model").isin(models))
