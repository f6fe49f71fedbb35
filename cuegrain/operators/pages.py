"""Web pages: text lines, links, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import page_lines


def text_lines(pages: DataFrame) -> DataFrame:
    """Ordered text lines of each page."""
    return page_lines(pages)


def title(pages: DataFrame) -> DataFrame:
    """The first heading, else the page title without what follows its last bar."""
    h1 = F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1)
    head = F.regexp_replace(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), " *[|] *[^|]*$", "")
    return pages.select("page_id", F.trim(F.when(h1 != "", h1).otherwise(head)).alias("title"))


def links(pages: DataFrame) -> DataFrame:
    """Every href in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href"))


def slug_of(url: Column) -> Column:
    """The last part of a path, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]+)/?$", 1)


def url_parts(url: Column) -> dict[str, Column]:
    host = F.regexp_extract(url, "^https?://([^/?#]+)", 1)
    return {
        "host": host,
        "path": F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1),
        "slug": slug_of(url),
        "is_mobile": host.startswith("m."),
        "desktop": F.regexp_replace(url, "^(https?://)m[.]", "$1"),
    }


def first_entries(rows: DataFrame) -> DataFrame:
    """The first page of each slug, in page order; rows have page_id and slug."""
    n = F.row_number().over(Window.partitionBy("slug").orderBy("page_id"))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
