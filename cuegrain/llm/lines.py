"""Line dedup by site-relative frequency, in DataFrame functions only.

Per host, the pages that hold a line are divided by the host's pages; lines whose share exceeds
RATIO are boilerplate and go from each page of that host. The ratio is the whole test, on hosts of
any size; LEAST = 2 only says that a line on a single page is no repeat, or a host of one page
would lose all its lines.

A line counts once a page. Counts are summed before the shuffle, so a line on a third of all
pages is no hot key. A host has fewer than (its lines a page) / RATIO boilerplate lines, so its
list is small; the lists are a staged table, and Spark broadcasts it only if its files are under
the broadcast threshold, else it joins by host and splits hot hosts.

Defined cases: rows without a host are one host of their own, and so, apart from them, are those
whose address names none; lines are compared without white space at their ends; blank lines are
never counted or dropped; a null or empty page has no lines and is kept as it is; repeated pages
count as pages of their own; columns of any name stay; an empty table gives an empty one. Lines
are told by 128-bit MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, staged, without

RATIO, LEAST = 0.1, 2
BLANKS = " \t\n\x0b\f\r"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: Tags that end a line, and the character references that pages use.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """The text of a page, a line for each block; scripts, styles and comments go."""
    text = F.translate(F.coalesce(html, F.lit("")), "\r\n", "  ")
    for pattern, to in (
        ("(?i)<script[^>]*>.*?</script>", ""),
        ("(?i)<style[^>]*>.*?</style>", ""),
        ("<!--.*?-->", ""),
        (f"(?i)</?(?:{BLOCKS})(?:[ /][^>]*)?>", "\n"),
        ("<[^>]*>", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(df: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Per host (column `host` of `df`) the MD5s of its boilerplate lines in the text column `text`."""
    keys = F.transform(F.filter(F.transform(F.split("text", "\n"), trimmed), lambda x: F.length(x) > 0), lambda x: F.unhex(F.md5(x)))
    lines = df.select("host", F.explode(F.array_distinct(keys)).alias("line"))
    pages = df.groupBy("host").agg(F.count("*").alias("pages"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = counts.join(pages, "host").where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("boilerplate"))


def dedup(df: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST, to: str = "text") -> DataFrame:
    """`df` with `to`, the text without boilerplate lines, and n_lines, n_dropped (lines that are not blank)."""
    rest = without(df, to, "n_lines", "n_dropped")
    # a null host gets a name that no host has; the row goes along as one struct, so no names can clash
    source = df.select(F.struct(*map(col, rest)).alias("_row"), F.coalesce(host, F.lit("\u0000")).alias("host"), text.alias("text"))
    lists = staged(boilerplate(source.select("host", "text"), ratio, least), "boilerplate")
    joined = source.join(lists, "host", "left")
    split = F.split("text", "\n")
    is_line = lambda x: F.length(trimmed(x)) > 0
    kept = F.when(F.col("boilerplate").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains("boilerplate", F.unhex(F.md5(trimmed(x))))))
    full = joined.select("_row", split.alias("_all"), kept.alias("_kept"))
    counted = full.select("_row", F.array_join("_kept", "\n").alias(to), F.size(F.filter("_all", is_line)).cast("long").alias("n_lines"), F.size(F.filter("_kept", is_line)).cast("long").alias("_left"))
    return counted.select("_row.*", to, "n_lines", (F.col("n_lines") - F.col("_left")).alias("n_dropped"))


def pages(df: DataFrame) -> DataFrame:
    """Per page its host, line counts and the text left."""
    lines = F.filter(F.transform(F.split(page_text(F.col("html")), "\n"), trimmed), lambda x: F.length(x) > 0)
    read = staged(df.select("page_id", host_of(F.col("url")).alias("site"), F.array_join(lines, "\n").alias("body")), "page-lines")
    found = dedup(read, F.col("site"), F.col("body"), to="kept_text")
    return found.select("page_id", F.coalesce("site", F.lit("")).alias("host"), "n_lines", "n_dropped", "kept_text")


def documents(df: DataFrame) -> DataFrame:
    """Documents with each source as a site: the same columns, boilerplate lines gone from the text."""
    return dedup(df, F.col("source"), F.col("text")).select(*map(col, df.columns))


def _twin(html: str) -> str:
    text = f"replace(replace(coalesce({html}, ''), chr(13), ' '), chr(10), ' ')"
    for pattern, to in (
        ("(?i)<script[^>]*>.*?</script>", "''"),
        ("(?i)<style[^>]*>.*?</style>", "''"),
        ("<!--.*?-->", "''"),
        (f"(?i)</?(?:{BLOCKS})(?:[ /][^>]*)?>", "chr(10)"),
        ("<[^>]*>", "''"),
    ):
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    for name, char in REFERENCES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


ORACLE = rf"""
with p as (select row_number() over () rid, page_id, case when url is null then chr(1) else lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) end host,
    {_twin("html")} t from pages),
l as (select rid, host, i, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) x
    from (select rid, host, unnest(string_split(t, chr(10))) x, generate_subscripts(string_split(t, chr(10)), 1) i from p)),
k as (select * from l where x <> ''),
c as (select host, x, count(distinct rid) n from k group by all),
h as (select host, count(*) pages from p group by all),
b as (select host, x from c join h using (host) where n >= {LEAST} and n > {RATIO} * pages),
f as (select k.*, b.x is not null gone from k left join b using (host, x))
select page_id, case when p.host = chr(1) then '' else p.host end host, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_dropped, 0)::bigint n_dropped, coalesce(kept_text, '') kept_text
from p left join (select rid, count(*) n_lines, count(*) filter (gone) n_dropped,
    string_agg(x, chr(10) order by i) filter (not gone) kept_text from f group by rid) using (rid)
"""
