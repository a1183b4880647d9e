"""Which texts contain which patterns, by postings of their q-grams.

A pattern of up to ``MOST`` characters is itself looked up among the texts' runs of its
length, so every pair found is one. A longer pattern is looked up under the one of its runs
of ``MOST`` characters that the fewest texts have, and only those texts are compared with
it. Texts are listed under runs of those lengths only that some pattern has.

Exploded rows count as the rows they came from in Spark's estimates, and compressed files as
what they hold, so joins here are told to shuffle: otherwise tables of millions of rows
are collected by the driver to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 8


def runs(c: Column, q: int) -> Column:
    """The distinct runs of q characters; none in a shorter text."""
    at = F.sequence(F.lit(1), F.length(c) - q + 1)
    return F.when(F.length(c) >= q, F.array_distinct(F.transform(at, lambda i: F.substr(c, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def containing(patterns: DataFrame, texts: DataFrame, pattern: str = "pattern", text: str = "text") -> DataFrame:
    """(pattern, text): distinct pairs where text contains pattern, which is not empty.

    Both are taken once each; what belongs to them is joined back by the caller, so texts
    that many rows share are compared once.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    t = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    sizes = sorted(r[0] for r in p.select(F.least(F.length("pattern"), F.lit(MOST))).distinct().collect())  # MOST rows at most
    posted = t.select("text", F.explode(F.concat(F.array().cast("array<string>"), *[runs(F.col("text"), q) for q in sizes])).alias("run"))
    brief = p.where(F.length("pattern") <= MOST)
    short = brief.join(posted.hint("merge"), F.col("run") == F.col("pattern")).select("pattern", "text")
    lasting = posted.where(F.length("run") == MOST)
    often = lasting.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    each = p.where(F.length("pattern") > MOST).select("pattern", F.explode(runs(F.col("pattern"), MOST)).alias("run"))
    # A run that no text has rules the pattern out.
    rarest = each.join(often.hint("merge"), "run", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).where("r.n > 0").select("pattern", "r.run")
    long = rarest.join(lasting.hint("merge"), "run").where(F.contains("text", "pattern")).select("pattern", "text")
    return long.unionByName(short)
