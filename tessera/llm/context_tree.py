"""Context-tree weighting over binary-decomposed bytes.

A byte is coded as eight binary decisions; each decision (the bits of the byte
so far) has a context tree of its own whose contexts are the preceding bytes,
0 to ``depth`` of them.  A node's counts give the Krichevsky-Trofimov
probability Pe of its bits; bottom-up,

    Pw = Pe                            at full depth,
    Pw = 1/2 Pe + 1/2 prod(children)   above,

and the prediction of a node is its own estimate with weight alpha = Pe / 2Pw
and its child's with 1 - alpha.  Counts come from training texts only; a
text is preceded by ``depth`` bytes 0xFF and ended by one (UTF-8 has no such
byte), so the probabilities of all texts add up to one.

The counts are tables: one row per node, one aggregation per level on the way
up, one join per level on the way down.  Nothing of the tree is collected.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import store

MOST_DEPTH = 6  # a context, a byte and its bits fit a bigint
MARK = 0xFF


def gram_run(raw: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams (``depth`` bytes of context and the byte, lowest) of a run of texts, and each text's first place.

    Every byte of a text and the mark behind it is predicted once.
    """
    n = len(bounds) - 1
    padded = np.full(len(raw) + n * (depth + 1), MARK, dtype=np.uint64)
    size = np.diff(bounds)
    shift = np.repeat(np.arange(n, dtype=np.int64) * (depth + 1) + depth, size)
    padded[np.arange(len(raw)) + shift] = raw
    grams = padded[depth:].copy()
    for j in range(1, depth + 1):
        grams |= padded[depth - j:len(padded) - j] << np.uint64(8 * j)
    ends = bounds[1:] + np.arange(n) * (depth + 1)  # the places of the end marks in ``grams``
    keep = np.ones(len(grams), dtype=bool)
    for j in range(1, depth + 1):  # what follows an end mark is the next text's padding
        at = ends + j
        keep[at[at < len(grams)]] = False
    return grams[keep], bounds[:-1] + np.arange(n)


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    inverse = 1 / y
    series = inverse / 12 - inverse * inverse * inverse / 360 + F.pow(inverse, F.lit(5)) / 1260
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _log_pe(zeros: Column, ones: Column) -> Column:
    """Log of the block probability (KT) of that many zeros and ones."""
    return (_log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi))


def _bits(grams: DataFrame, *keep: str) -> DataFrame:
    """One row per gram and bit: its node (context and bits before, as one bigint) and the bit."""
    return grams.select(*keep, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "gram").select(
        *keep, "gram",
        F.expr("shiftleft(shiftright(gram, 8), 8) | shiftleft(1L, k) | shiftright(gram & 255, 8 - k)").alias("node"),
        F.expr("shiftright(gram, 7 - k) & 1").alias("bit"))


def _parent(depth: int) -> Column:
    """The node of the context without its oldest byte; ``depth`` is that of the child."""
    return F.expr(f"node & {(1 << 8 * depth) - 1}L")


def _weighted(level: DataFrame, leaf: bool) -> DataFrame:
    pe = _log_pe(F.col("zeros"), F.col("ones"))
    if leaf:
        rows = level.withColumn("log_pw", pe).withColumn("alpha", F.lit(1.0))
    else:
        rows = level.withColumn("log_pe", pe)
        high, low = F.greatest("log_pe", "below"), F.least("log_pe", "below")
        rows = rows.withColumn("log_pw", high + F.log1p(F.exp(low - high)) - math.log(2))
        rows = rows.withColumn("alpha", F.exp(F.col("log_pe") - math.log(2) - F.col("log_pw")))
    kt = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    return rows.select("node", "zeros", "ones", "log_pw", "alpha", kt.alias("kt"))


def log10_of_grams(counts: DataFrame, depth: int) -> DataFrame:
    """(gram, value): log10 probability of each gram's byte after its context.

    ``counts`` has one row per gram (bigint ``gram``, ``n`` times seen in
    training); grams with n = 0 are predicted from what their contexts have
    seen.  No training at all predicts every bit with one half.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 0 to {MOST_DEPTH}")
    level = _bits(counts, "n").groupBy("node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("ones"))
    levels = {depth: store.written(_weighted(level, True), "ctw-up")}
    for d in range(depth, 0, -1):
        level = levels[d].groupBy(_parent(d).alias("node")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_pw").alias("below"))
        levels[d - 1] = store.written(_weighted(level, False), "ctw-up")
    # Downwards: what the shallower nodes give to a one, and the weight they leave to deeper ones.
    down = levels[0].select("node", (F.col("alpha") * F.col("kt")).alias("one"), (1 - F.col("alpha")).alias("rest"))
    for d in range(1, depth + 1):
        above = down.select(F.col("node").alias("up"), "one", "rest")
        down = levels[d].withColumn("up", _parent(d)).join(above, "up").select(
            "node", (F.col("one") + F.col("rest") * F.col("alpha") * F.col("kt")).alias("one"),
            (F.col("rest") * (1 - F.col("alpha"))).alias("rest"))
    p = F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one"))
    return _bits(counts).join(down.select("node", "one"), "node").groupBy("gram").agg(F.sum(F.log10(p)).alias("value"))
