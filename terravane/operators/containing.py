"""Which texts contain which parts, by an equality join on groups of letters.

A part occurs in a text only if its rarest group of GROUP letters does. Texts give all their groups, parts their
rarest one, as counted over the texts; what shares it is checked by its letters. A part with a group that no text has is gone
at once. Shorter parts are groups themselves. Neither side is sent to all tasks, and no pair is
looked at that has not a group of letters in common.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a group.
GROUP = 3


def groups(text: Column, size: int) -> Column:
    """All distinct groups of so many letters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda k: F.substr(text, k, F.lit(size)))))


def containing(texts: DataFrame, parts: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """on, text, part: each part that occurs in a text with equal columns `on`; blank ones match nothing.

    texts (text and on) and parts (part and on) have distinct rows and are read more than once.
    """
    on = list(on)
    # Groups carry a hash for their text, which may be long; texts of equal hashes are told apart when their letters are checked.
    whole = texts.filter("text <> ''").select(*on, "text", F.xxhash64("text").alias("of"))
    given = whole.select(*on, "of", F.explode(groups(F.col("text"), GROUP)).alias("group"))
    counted = given.groupBy(*on, "group").agg(F.count(F.lit(1)).alias("n"))
    asked = parts.filter(F.length("part") >= GROUP).select(*on, "part", F.explode(groups(F.col("part"), GROUP)).alias("group"))
    met = asked.join(counted, [*on, "group"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = met.groupBy(*on, "part").agg(F.min(F.struct("n", "group")).alias("x")).filter("x.n > 0").select(*on, "part", "x.group")
    long = given.join(rarest, [*on, "group"]).select(*on, "of", "part")
    short = parts.filter((F.length("part") < GROUP) & (F.col("part") != "")).select(*on, "part")
    letters = F.flatten(F.array(*(F.coalesce(groups(F.col("text"), k), F.array().cast("array<string>")) for k in range(1, GROUP))))
    single = whole.select(*on, "of", F.explode(letters).alias("part")).join(short, [*on, "part"]).select(*on, "of", "part")
    met = long.unionByName(single).distinct()  # texts of one hash
    return met.join(whole, [*on, "of"]).filter(F.contains("text", F.col("part"))).select(*on, "text", "part")


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """on, one, other: texts of the left (column one) and the right (other) of which one contains the other.

    Both have distinct rows. Each pair comes once: equal texts come from the first join alone.
    """
    on = list(on)
    part = lambda df: df.select(*on, F.col("text").alias("part"))
    over = containing(left, part(right), on).select(*on, F.col("text").alias("one"), F.col("part").alias("other"))
    under = containing(right, part(left), on).select(*on, F.col("part").alias("one"), F.col("text").alias("other"))
    return over.unionByName(under.filter("one <> other"))
