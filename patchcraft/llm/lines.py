"""Line dedup by site-relative frequency (operator 10), with DataFrame functions only.

A line that stands on a large share of a host's pages is that site's
boilerplate.  Shares are relative to the host, so a line common on one site
stays on others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

#: Share of a host's pages from which a line is boilerplate, and the least pages of a line for a share to mean anything.
MAX_SHARE, MIN_PAGES = 0.3, 3
# Fixed: elements whose content is no text, and elements that break lines.
UNSEEN = r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^>]*)?>"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """The visible text lines of a page, trimmed, without empty ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), "<[^>]*>", "")
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.array_remove(trimmed, "")


def boilerplate(pages: DataFrame, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, boiler``: the MD5 of each line on more than ``max_share`` of the pages of ``pages(host, lines)`` of that host.

    A host has at most (lines of its mean page) / ``max_share`` of them, which
    bounds the array.
    """
    totals = written(pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")), "hosts")
    # A page counts once for a line; equal lines of a host are added up before they are exchanged.
    seen = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, "host").where(F.col("n") > F.col("host_pages") * F.lit(max_share))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("boiler"))


def line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each page: ``page_id, host, n_lines, n_dropped, text``, the text being the kept lines.

    Lines on more than ``max_share`` of their host's pages, and on
    ``min_pages`` pages at least, go.  Null or empty HTML has no lines.  A null
    or unreadable URL belongs to the host named "".  Repeated rows count as
    pages of their own.  Empty input: no rows.
    """
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines"))
    # The table of boilerplate is written, so that Spark sees its size before it chooses to broadcast it.
    judged = split.join(written(boilerplate(split.select("host", "lines"), max_share, min_pages), "boilerplate"), "host", "left")
    kept = F.when(F.col("boiler").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("boiler"), F.unhex(F.md5(x)))))
    rows = judged.select("page_id", "host", "lines", F.explode(F.array(kept)).alias("left"))
    return rows.select(
        "page_id", "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.array_join("left", "\n").alias("text"),
    )
