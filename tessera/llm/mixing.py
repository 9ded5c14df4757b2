"""Mixing sources to target weights: hierarchical budgets over a domain - language - source tree.

DataFrame and SQL functions only.

* Supplies are summed by leaf; a leaf can give ``max_epochs`` times its tokens.
* The token budget flows down the tree.  Among siblings it is shared by weight;
  a child whose subtree cannot take its share takes all it can, and what it
  leaves goes to its siblings first.  Because a node's capacity is that of its
  whole subtree, an ancestor's other children are only asked for what the
  whole family cannot take.
* A leaf's share is spent on whole epochs and then on a token prefix of one
  more epoch, whose order is a seeded hash of the document id.  Hash buckets
  locate the place where the prefix ends: buckets before it are taken whole,
  only the rows of that one bucket are ordered.

All amounts are integers: shares are cumulative floors, so children's budgets
add up to exactly what their parent gives out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.operators.joins import join_small

LEVELS = ("domain", "lang", "source")
BIG = "decimal(38,0)"
MOST_LEAVES = 200_000  # rows of a plan that is broadcast (tens of megabytes)


@dataclass(frozen=True)
class Mixture:
    """``domain``, ``lang``, ``source``: the tree's keys; ``weights``: a positive integer of each level's node."""

    domain: Column
    lang: Column
    source: Column
    weights: dict[str, Column]  # by level, over the columns domain, lang and source
    budget_percent: int = 100  # of the tokens supplied
    max_epochs: int = 4
    seed: int = 0


def n_tokens(text_col: str) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def leaves_of(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, domain, lang, source, n_tokens) of every row; a null key is the empty name."""
    keys = [F.coalesce(getattr(mix, k).cast("string"), F.lit("")).alias(k) for k in LEVELS]
    return docs.select(F.col(id_col).alias("id"), *keys, n_tokens(text_col).alias("n_tokens"))


def share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``budget`` to siblings, given ``weight``, ``capacity`` and ``parent_budget``; shortages go to siblings."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: c.cast(BIG)
    rows = children.where("weight > 0").withColumns({
        "full_before": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "weight_from": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("full", big(F.col("capacity")) * big(F.col("weight_from"))
                           <= big(F.col("weight")) * big(F.col("parent_budget") - F.col("full_before")))
    shared = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    rows = rows.withColumns({
        "left": F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(w),
        "all_weight": F.sum(shared).over(w),
        "weight_to": F.sum(shared).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("weight_under", F.col("weight_to") - F.col("weight"))
    cut = lambda c: F.expr(f"cast(`left` as {BIG}) * cast({c} as {BIG}) div all_weight")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("capacity"))
                           .otherwise(cut("weight_to") - cut("weight_under"))).select(
        *parent, child, "capacity", "budget")


def plan(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """One row per leaf: domain, lang, source, supply, budget, epochs (whole ones), rest (tokens of one more)."""
    supply = store.written(leaves.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")).where("supply > 0"), "supply")
    node = supply.withColumn("capacity", F.col("supply") * mix.max_epochs)
    total = supply.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0] * int(mix.budget_percent) // 100
    up = None
    for depth in range(1, len(LEVELS) + 1):
        parent, child = list(LEVELS[:depth - 1]), LEVELS[depth - 1]
        level = node.groupBy(*parent, child).agg(F.sum("capacity").alias("capacity")).withColumn(
            "weight", F.coalesce(mix.weights[child], F.lit(1)).cast("long"))
        # Below the root, each node's budget meets its children.
        level = level.withColumn("parent_budget", F.lit(total).cast("long")) if up is None else level.join(
            up.select(*parent, F.col("budget").alias("parent_budget")), parent)
        up = share(level, parent, child)
    out = up.join(supply, list(LEVELS))
    return out.select(*LEVELS, "supply", "budget", F.expr("budget div supply").alias("epochs"),
                      F.expr("budget % supply").alias("rest"))


def _place(mix: Mixture) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"),
                             F.coalesce(F.col("id").cast("string"), F.lit(""))))


def _planned(rows: DataFrame, plans: DataFrame, mix: Mixture) -> DataFrame:
    # The plan has one row per leaf; under the checked bound it is broadcast and a hot leaf stays where it is.
    planned = join_small(rows, plans, list(LEVELS), "inner", max_rows=MOST_LEAVES)
    return planned.where("n_tokens > 0").withColumn("place", _place(mix)).withColumn("bucket", F.substring("place", 1, 3))


def cut_points(leaves: DataFrame, plans: DataFrame, mix: Mixture) -> DataFrame:
    """The plan with each leaf's last bucket (``last``) and the tokens that it still gives (``in_last``)."""
    plans = plans.select(*LEVELS, "epochs", "rest")
    sums = _planned(leaves, plans, mix).groupBy(*LEVELS, "epochs", "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before < rest")
    ends = sums.groupBy(*LEVELS).agg(F.max("bucket").alias("last"), F.max("before").alias("before"))
    return plans.join(ends, list(LEVELS), "left").select(
        *LEVELS, "epochs", "rest", F.coalesce("last", F.lit("")).alias("last"),
        (F.col("rest") - F.coalesce("before", F.lit(0))).alias("in_last"))


def select(rows: DataFrame, cuts: DataFrame, mix: Mixture) -> DataFrame:
    """The drawn rows, one per document and epoch, with ``epoch`` and ``take_tokens``.

    ``rows`` has id, domain, lang, source, n_tokens and any other columns.
    Rows without tokens are never drawn.  Rows of equal id are ordered by
    their token count; equal rows are interchangeable.
    """
    keep = [c for c in rows.columns]
    drawn = _planned(rows, cuts, mix)
    whole = F.expr("if(epochs > 0, sequence(0L, cast(epochs as bigint) - 1), cast(array() as array<bigint>))")
    sure = F.when(F.col("bucket") < F.col("last"), F.concat(whole, F.array(F.col("epochs").cast("long")))).otherwise(whole)
    full = drawn.select(*keep, F.explode(sure).alias("epoch"), F.col("n_tokens").alias("take_tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    part = (drawn.where("bucket = last and rest > 0")
            .withColumn("left_here", F.col("in_last") - F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
            .where("left_here > 0")
            .select(*keep, F.col("epochs").cast("long").alias("epoch"),
                    F.least("n_tokens", "left_here").alias("take_tokens")))
    return full.union(part)


def mix_plan(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(leaves, cuts): the token counts of all rows, written once, and the budget of every leaf."""
    store.prepare(docs.sparkSession)
    leaves = store.written(leaves_of(docs, mix, id_col, text_col), "leaves")
    plans = store.written(plan(leaves, mix), "plan")
    return leaves, store.written(cut_points(leaves, plans, mix), "cuts")


def mixture(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, take_tokens of every draw; texts are read once.

    Empty tables and tables without tokens draw nothing; a null id sorts as
    the empty id; null keys form the leaf of the empty name.
    """
    leaves, cuts = mix_plan(docs, mix, id_col, text_col)
    return select(leaves, cuts, mix).select(F.col("id").alias("doc_id"), *LEVELS, "epoch", "n_tokens", "take_tokens")


def mix_documents(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``mixture``, with every column of the drawn documents before the columns of the draw.

    Texts are read twice and, but for the rows of the cut buckets, not shuffled
    when the plan is small enough for the runtime to broadcast it.
    """
    _, cuts = mix_plan(docs, mix, id_col, text_col)
    row = store.fresh(docs, "row")
    keys = [F.coalesce(getattr(mix, k).cast("string"), F.lit("")).alias(k) for k in LEVELS]
    rows = docs.select(F.struct(*docs.columns).alias(row), F.col(id_col).alias("id"), *keys,
                       n_tokens(text_col).alias("n_tokens"))
    drawn = select(rows, cuts, mix)
    names = [store.fresh(docs, c) for c in ("domain", "epoch", "n_tokens", "take_tokens")]
    new = [F.col(c).alias(n) for c, n in zip(("domain", "epoch", "n_tokens", "take_tokens"), names)]
    return drawn.select(*(F.col(row)[c].alias(c) for c in docs.columns), *new)


def by_name(column: str, weights: dict[str, int], other: int = 1) -> Column:
    """Weights from a literal table."""
    return reduce(lambda w, kv: w.when(F.col(column) == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0)).otherwise(other)
