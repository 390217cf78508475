"""Boilerplate lines by site-relative frequency.

A page's lines come from its markup by fixed rules: comments, scripts and styles
go, block tags break lines, other tags go, white space collapses, blank lines go.
For every host, the number of pages that contain a line is divided by the host's
pages; lines above ``ratio`` that at least two pages contain are boilerplate there
and are dropped from all its pages, on a host of any size.

Everything is a JVM expression. Lines travel as 128-bit digests, once per page,
and are counted with map-side combine. A host has at most (mean lines per page) /
ratio boilerplate lines, so their list is bounded and is joined to pages by host;
the lists are written first, so the join is a broadcast when they are small and
otherwise has plain exchanges, whose hot host adaptive execution can split.

Nulls and edge cases: null markup counts as empty and has no lines; a null or
unparsable URL belongs to the host ''. Rows repeated whole are pages of their own.
Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialize

BLOCK_TAG = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def lines_of(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern, put in ((r"(?s)<!--.*?-->", " "), (r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (BLOCK_TAG, "\n"), (r"<[^>]*>", ""), (r"[ \t\r\f]+", " ")):
        text = F.regexp_replace(text, pattern, put)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 0.3) -> DataFrame:
    """Per page: page_id, host, n_lines, n_dropped, text (the lines that stay)."""
    # the lines are parsed once and written; they are needed twice
    rows = materialize(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines")), "lines")
    totals = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    common = counted.join(totals, "host").where((F.col("n") >= 2) & (F.col("n") > F.col("pages") * ratio))
    lists = materialize(common.groupBy("host").agg(F.collect_list("line").alias("boilerplate")), "boilerplate")
    judged = rows.join(lists, "host", "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boilerplate", F.unhex(F.md5(x)))))
    return judged.withColumn("kept", kept).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"))
