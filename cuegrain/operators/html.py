"""Pages as streams of HTML tokens: text, tags, comments and elements without markup inside.

Tokens of a page are rows in order. How deep a tag stands is a running sum over them, and a box ends
at the tag that closes its own level, so boxes may nest, hold other elements, or never be closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements whose content is no markup and goes, elements that end a line, character references.
RAW_ELEMENTS = ("script", "style", "iframe")
LINE_ELEMENTS = "p|div|li|ul|ol|h[1-6]|br|nav|article|section|footer|header|title|head|body|html|table|tr"
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))

#: One token. An element or comment that is never closed reaches to the end of the page; a lone < is text.
TOKEN = "(?is)" + "|".join([f"<{e}(?:[ /\t\r\n][^>]*)?>.*?(?:</{e}[^>]*>|\\z)" for e in RAW_ELEMENTS] + [r"<!--.*?(?:-->|\z)", "<[^>]*>", "[^<]+", "<"])
RAW = "(?i)^<(?:" + "|".join(RAW_ELEMENTS) + "|!--)"
LINE_TAG = f"(?i)^</?(?:{LINE_ELEMENTS})(?:[ /\t\r\n][^>]*)?>"
BOX = r'(?is)^<div[^>]*class="[^">]*embedded-video-wrapper[^">]*"'


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def is_text(token: Column) -> Column:
    return ~token.rlike("(?s)^<[^>]*>") & ~token.rlike(RAW)


def shown(token: Column) -> Column:
    """What a token adds to a page's lines: a text itself, a tag that ends a line its end, others nothing."""
    return F.when(token.rlike(LINE_TAG), "\n").when(is_text(token), F.translate(token, "\r\n\t￼", "   ")).otherwise("")


def lines(text: Column) -> Column:
    """The lines of a page's text that hold something, with references resolved and blanks folded."""
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: x != "")


def stream(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The tokens of pages (page_id, html): page_id, at, token, and of `div` tags `level`, the depth that they open or close."""
    rows = pages.select(key, F.posexplode(tokens(F.col("html"))).alias("at", "token"))
    opens, closes = F.col("token").rlike("(?i)^<div[ />\t\r\n]"), F.col("token").rlike("(?i)^</div[ >\t\r\n]")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy(key).orderBy("at"))
    return rows.withColumn("level", F.when(opens, depth).when(closes, depth + 1))


def boxes(tokens_: DataFrame, opening: str = BOX, key: str = "page_id") -> DataFrame:
    """The `div` boxes whose tag matches `opening`: page_id, at, till, the place of the tag that closes it (null: none does), and number, from 1."""
    same_level = Window.partitionBy(key, "level").orderBy("at")
    ends = tokens_.where("level is not null").withColumn("till", F.lead("at").over(same_level))
    number = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return ends.where(F.col("token").rlike(opening)).select(key, "at", "till", number.alias("number"))


def page_lines(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Ordered lines of each page (page_id, pos, line): scripts, styles, frames, comments and player boxes go, inline tags unwrap."""
    has_box = F.coalesce(F.contains("html", F.lit("embedded-video-wrapper")), F.lit(False))
    whole = pages.where(~has_box).select(key, F.array_join(F.transform(tokens(F.col("html")), shown), "").alias("text"))
    rows = stream(pages.where(has_box), key)
    marked = rows.join(boxes(rows, key=key), [key, "at"], "left")
    # within a box: some box before has not ended yet
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    until = F.max(F.when(F.col("number").isNotNull(), F.coalesce("till", F.lit(2**31 - 1)))).over(order)
    kept = marked.withColumn("_u", until).withColumn("_s", F.when(F.coalesce(F.col("at") > F.col("_u"), F.lit(True)), shown(F.col("token"))).otherwise(F.when(F.col("at") == F.col("_u"), "\n").otherwise("")))
    parts = F.array_sort(F.collect_list(F.struct("at", "_s")))
    rest = kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["_s"]), "").alias("text"))
    return whole.unionByName(rest).select(key, F.posexplode(lines(F.col("text"))).alias("pos", "line"))


FRAME = r'(?is)^<iframe[^>]*src="https?://player\.vimeo\.com/video/([0-9]+)'
INFO = r'(?is)^<div[^>]*class="[^">]*video-meta-info[^">]*"'
LABELS = "(?i)^<(h[1-6]|strong|b|p)>"


def players(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The players of each page in order: page_id, number (as the page counts them), video and label (null: none).

    In a page with player boxes each box counts, and gives its first player and its first info line, if
    they stand before its end. Where no box has a player, each frame counts, and the heading or bold
    line right before it is its label.
    """
    rows = stream(pages, key)
    video = F.nullif(F.regexp_extract("token", FRAME, 1), F.lit(""))
    named = rows.withColumn("video", video).withColumn("words", F.when(is_text(F.col("token")) & (F.trim(F.translate("token", "\r\n\t", "   ")) != ""), F.trim("token")))
    backwards = Window.partitionBy(key).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda what, c: F.last(F.when(what, F.struct("at", c)), ignorenulls=True).over(backwards)
    is_info = F.col("token").rlike(INFO)
    # the text right after an info line's tag, seen from that tag, and then from every tag before it
    told = named.withColumn("_text", F.struct("at", F.lead("words").over(Window.partitionBy(key).orderBy("at")).alias("words")))
    seen = told.withColumn("_frame", ahead(F.col("video").isNotNull(), "video")).withColumn("_info", F.last(F.when(is_info, F.col("_text")), ignorenulls=True).over(backwards))
    boxed = seen.join(boxes(rows, key=key), [key, "at"])
    inside = lambda x: F.col("till").isNull() | (F.col(x)["at"] < F.col("till"))
    in_boxes = boxed.where(F.col("_frame").isNotNull() & inside("_frame")).select(key, "number", F.col("_frame.video").alias("video"), F.when(inside("_info"), F.col("_info.words")).alias("info"))
    title = F.trim(F.split(F.regexp_replace("info", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\s+", ""), ",")[0])
    found = in_boxes.select(key, "number", "video", title.alias("label"))
    order = Window.partitionBy(key).orderBy("at")
    solid = named.where("words is not null or trim(translate(token, '\r\n\t', '   ')) <> ''")
    back = lambda n: F.lag("token", n).over(order)
    tag = F.lower(F.regexp_extract(back(3), LABELS, 1))
    label = F.when((tag != "") & (F.lower(back(1)) == F.concat(F.lit("</"), tag, F.lit(">"))), F.lag("words", 2).over(order))
    bare = solid.withColumn("label", label).where("video is not null")
    bare = bare.withColumn("number", F.row_number().over(order)).join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(bare.select(key, "number", "video", "label"))
