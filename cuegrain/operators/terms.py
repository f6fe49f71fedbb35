"""Terminology: glossary variants, candidate terms, unknown terms; repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common words that are no terms.
STOPWORDS = ("the", "and", "but", "for", "not", "you", "all", "this", "that", "with", "from", "they", "then", "there", "when", "what", "who", "how", "his", "her", "was", "are", "has", "have")


def known_terms(glossary: DataFrame) -> DataFrame:
    """Lower-case variants of every entry and the single words of those with several."""
    variants = glossary.select(F.explode(F.transform(F.split("en", "/"), lambda x: F.trim(F.lower(x)))).alias("term")).where("term <> ''")
    words = variants.where(F.contains("term", F.lit(" "))).select(F.explode(F.split("term", " ")).alias("term")).where("term <> ''")
    return variants.union(words).distinct()


def candidates(docs: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Capitalised words inside sentences, and pairs of them, that a document uses at least twice and the glossary lacks.

    A word and its neighbour are seen in their sentence's array, so only candidates become rows.
    """
    # what a term cannot hold becomes a mark, so that words keep their places until it is taken out
    sent = docs.select("doc_id", F.explode(F.split(F.regexp_replace("text", "[^a-zA-Z'.!? \t\n-]", "\u0001"), r"[.!?]+[ \t\n]+")).alias("sentence"))
    sent = sent.where(F.col("sentence").rlike("[A-Z]"))
    words = F.filter(F.split("sentence", r"[ \t\n]+"), lambda w: w != "")
    clean = sent.select("doc_id", F.transform(words, lambda w: F.translate(w, "\u0001.!?", "")).alias("c"))
    capital = lambda w: F.coalesce(F.substring(w, 1, 1).between("A", "Z"), F.lit(False))

    def terms(c: Column, i: Column) -> Column:
        after = F.get("c", i + 1)
        single = F.when(~F.lower(c).isin(*STOPWORDS), c)
        pair = F.when(capital(after), F.concat_ws(" ", c, after))
        return F.when((i > 0) & (F.length(c) >= 3) & capital(c), F.array(single, pair))

    found = clean.select("doc_id", F.explode(F.array_compact(F.flatten(F.array_compact(F.transform("c", terms))))).alias("term")).withColumn("key", F.lower("term"))
    fresh = found.join(known.withColumnRenamed("term", "key"), "key", "left_anti")
    return fresh.groupBy("doc_id", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def duplicate_runs(lines: DataFrame, least: int = 3) -> DataFrame:
    """Lines left after runs of `least` or more lines in a row go that all stood earlier in the document.

    lines: doc_id, pos, line (not empty). A line repeats if its first position is earlier.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("again", F.min("pos").over(Window.partitionBy("doc_id", "line")) < F.col("pos"))
    island = marked.withColumn("run", F.row_number().over(order) - F.row_number().over(Window.partitionBy("doc_id", "again").orderBy("pos")))
    sized = island.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "again", "run")))
    return sized.where(~(F.col("again") & (F.col("size") >= least))).select("doc_id", "pos", "line")
