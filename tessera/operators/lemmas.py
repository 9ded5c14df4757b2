"""Lemmas of forms that no table holds: suffix rewrites counted from known pairs.

A pair (form, lemma) says how a form's ending becomes its lemma's: the parts
behind their common beginning, with up to ``context`` letters before them.
Every such rewrite is counted over all pairs; of the rewrites of one ending
the most frequent stays.  An unseen form takes the rewrite of its longest
known ending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_small


def learn_rules(pairs: DataFrame, context: int = 3) -> DataFrame:
    """``(suffix, replacement, n)`` from ``(form, lemma)``: one rewrite an ending, the most frequent, ties by text.

    Partial and final aggregates: an ending of very many forms costs a row a
    task.  Pairs with a NULL or empty side are not used; repeated ones count
    once.
    """
    known = pairs.where((F.length("form") > 0) & (F.length("lemma") > 0)).select("form", "lemma").distinct()
    letters = F.sequence(F.lit(1), F.least(F.length("form"), F.length("lemma")))
    same = F.size(F.filter(letters, lambda i: F.substr("form", F.lit(1), i) == F.substr("lemma", F.lit(1), i)))
    at = known.select("form", "lemma", same.alias("same"))
    at = at.select("form", "lemma", F.explode(F.sequence(
        F.greatest(F.col("same") - context, F.lit(0)), F.col("same"))).alias("cut"))
    counts = at.groupBy(F.substr("form", F.col("cut") + 1).alias("suffix"),
                        F.substr("lemma", F.col("cut") + 1).alias("replacement")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("replacement", "n"), F.struct(-F.col("n"), "replacement"))
    return counts.groupBy("suffix").agg(best.alias("b")).select("suffix", "b.replacement", "b.n")


def lemmatize(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """``(form, lemma)`` of the distinct forms: the rewrite of the longest ending; unchanged where none applies.

    A rewrite that would leave nothing does not apply.
    """
    longest = rules.agg(F.max(F.length("suffix"))).first()[0] or 0
    rules = rules.select("suffix", "replacement")
    wanted = forms.where(F.length("form") > 0).select("form").distinct()
    ends = wanted.select("form", F.explode(F.sequence(F.lit(0), F.least(F.length("form"), F.lit(longest)))).alias("size"))
    ends = ends.withColumn("suffix", F.substr("form", F.length("form") - F.col("size") + 1))
    met = join_small(ends, rules, "suffix", "left")
    lemma = F.concat(F.substr("form", F.lit(1), F.length("form") - F.col("size")), F.col("replacement"))
    met = met.select("form", "size", F.when(F.length(lemma) > 0, lemma).alias("lemma"))
    best = F.max_by("lemma", F.when(F.col("lemma").isNotNull(), F.col("size")).otherwise(F.lit(-1)))
    return met.groupBy("form").agg(best.alias("lemma")).select("form", F.coalesce("lemma", "form").alias("lemma"))
