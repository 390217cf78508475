"""Content by URI under a security policy, registry files, and JSON sinks."""

from __future__ import annotations

import ipaddress
import socket
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ContentPolicy:
    allowed_hosts: list[str] = field(default_factory=list)
    allowed_paths: list[str] = field(default_factory=list)
    block_private_ips: bool = True
    max_bytes: int = 100 * 1024 * 1024
    timeout_seconds: float = 30.0


def data_uri(uri: Column) -> Column:
    """struct(mime, content) of a ``data:`` URI, null for others; the type defaults to text/plain."""
    pattern = r"^data:([^;,]*)((?:;[^;,]*)*),(.*)$"
    mime, flags, body = (F.regexp_extract(uri, f"(?s){pattern}", k) for k in (1, 2, 3))
    content = F.when(flags.contains(";base64"), F.unbase64(body)).otherwise(F.encode(F.url_decode(body), "utf-8"))
    return F.when(uri.startswith("data:"), F.struct(F.when(mime == "", "text/plain").otherwise(mime).alias("mime"), content.alias("content")))


def private_host(host: Column) -> Column:
    """Loopback, link-local, shared and private addresses of both kinds, and localhost."""
    p = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    is_ip = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    inside = (a == 10) | (a == 127) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    inside_v6 = F.lower(host).rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:.*)\]$")
    return (F.lower(host) == "localhost") | (is_ip & inside) | inside_v6


def refused(uri: Column, policy: ContentPolicy = ContentPolicy()) -> Column:
    """Why the policy refuses a URI, or null."""
    scheme, host, path = (F.try_parse_url(uri, F.lit(part)) for part in ("PROTOCOL", "HOST", "PATH"))
    remote = scheme.isin("http", "https")
    out = F.when(~F.coalesce(scheme, F.regexp_extract(uri, "^([a-z0-9]+):", 1)).isin("data", "http", "https", "file", "s3"), "unknown scheme")
    if policy.allowed_hosts:
        out = out.when(remote & ~host.isin(policy.allowed_hosts), "host not allowed")
    if policy.block_private_ips:
        out = out.when(remote & F.coalesce(private_host(host), F.lit(False)), "private address")
    if policy.allowed_paths:
        allowed = F.lit(False)
        for prefix in policy.allowed_paths:
            allowed = allowed | path.startswith(prefix)
        out = out.when((scheme == "file") & ~allowed, "path not allowed")
    return out


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:  # a redirect could leave what the policy allows
        return None


def _read(uri: str, policy: ContentPolicy) -> bytes:
    """The bytes of a URI, one more than the limit at most."""
    parts = urlsplit(uri)
    if parts.scheme in ("http", "https"):
        if policy.block_private_ips:
            for found in socket.getaddrinfo(parts.hostname, None):
                if not ipaddress.ip_address(found[4][0].split("%")[0]).is_global:
                    raise PermissionError("private address")
        with urllib.request.build_opener(_NoRedirect).open(uri, timeout=policy.timeout_seconds) as body:
            return body.read(policy.max_bytes + 1)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as body:
        return body.read(policy.max_bytes + 1)


def fetch(items: DataFrame, uri_col: str = "uri", policy: ContentPolicy = ContentPolicy()) -> DataFrame:
    """uri, content, error — one row per distinct URI that is not null; exactly one of the last two is set.

    ``data:`` URIs are decoded by expressions; the others are read on the executors, each once, in place of a listing of
    their store. What the policy refuses is not touched, what is longer than its limit has an error, and so has every
    failure of reading. A row holds at most ``max_bytes``, and a batch one row.
    """
    uris = items.select(F.col(uri_col).alias("uri")).where("uri is not null").distinct()
    judged = uris.withColumn("error", refused(F.col("uri"), policy)).withColumn("content", data_uri(F.col("uri"))["content"])
    inline = F.col("uri").startswith("data:") | F.col("error").isNotNull()
    too_long = F.octet_length("content") > policy.max_bytes
    problem = F.coalesce("error", F.when(F.col("content").isNull(), "not a data URI").when(too_long, "too large"))
    known = judged.where(inline).select("uri", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("error"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                content, error = None, None
                try:
                    content = _read(uri, policy)
                except Exception as e:  # noqa: BLE001 - any failure belongs to its row
                    error = f"{type(e).__name__}: {e}"
                if content is not None and len(content) > policy.max_bytes:
                    content, error = None, "too large"
                yield pd.DataFrame({"uri": [uri], "content": [content], "error": [error]})

    return known.unionByName(judged.where(~inline).select("uri").mapInPandas(read, "uri string, content binary, error string"))


def read_binary(spark: SparkSession, path: str, policy: ContentPolicy = ContentPolicy()) -> DataFrame:
    """(path, length, content) of files in any store that Spark reads, within the size limit."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= policy.max_bytes).select("path", "length", "content")


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(model, file, size) of a model folder's files, without their content."""
    parts = F.split("path", "/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return listed.select(F.element_at(parts, -2).alias("model"), F.element_at(parts, -1).alias("file"), F.col("length").alias("size"))


def registry_index(spark: SparkSession, path: str) -> DataFrame:
    """Models of an index file; any schema version but 1 is an error."""
    raw = spark.read.option("multiLine", "true").schema("schemaVersion int, models array<struct<name:string,type:string,description:string,size:bigint,variants:array<string>>>").json(path)
    checked = F.when(F.col("schemaVersion") == 1, F.col("models")).otherwise(F.raise_error(F.lit("unsupported index schema version")))
    return raw.select(F.inline(checked))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
