"""Temperature mixing: source shares to an exponent, then whole epochs and permuted blocks to budget.

The exponent is the largest step of a grid, found by bisection, at which the mixture keeps the
target entropy; it rises again where small sources would repeat too often. A source's budget is so
many whole epochs and, of one more, permuted blocks up to the budget; only the block where the
budget ends is cut between documents.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.llm.shared import stored

GRID = 4096
WORD = r"[^\x20\x09-\x0D]+"
NO_SOURCE = ""


def weights(tokens: list[int], exponent: float) -> np.ndarray:
    """Normalised powers of the shares; sources without tokens weigh nothing."""
    t = np.array(tokens, np.float64)
    total = t.sum()
    w = np.array([math.pow(x / total, exponent) if x > 0 else 0.0 for x in t])
    return w / w.sum() if total > 0 else w


def entropy(w: np.ndarray) -> float:
    return float(-sum(x * math.log(x) for x in w if x > 0))


def exponent(tokens: list[int], budget: int, share: float, repeats: float) -> float:
    """Largest grid exponent of 0 to 1 with ``share`` of the greatest entropy, raised to the least that repeats
    no source more than ``repeats`` times (where even 1 does, it is 1). Both tests are monotone in the exponent."""
    live = [t for t in tokens if t > 0]
    if not live:
        return 1.0

    def steps(good) -> int:
        """Least grid step from which on ``good`` holds; the last if it never does."""
        lo, hi = 0, GRID
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if good(weights(live, mid / GRID)) else (mid + 1, hi)
        return lo

    target = share * math.log(len(live)) - 1e-9
    low = steps(lambda w: entropy(w) < target)
    if low > 0 and entropy(weights(live, low / GRID)) < target:
        low -= 1
    least = steps(lambda w: all(budget * x <= repeats * t + 1e-6 for x, t in zip(w, live)))
    return max(low, least) / GRID


def _digest(*parts) -> Column:
    """First 48 bits of an MD5, which other engines can repeat."""
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def mix(docs: DataFrame, budget: int | None = None, share: float = 0.98, repeats: float = 4.0, block_tokens: int = 1 << 20,
        seed: int = 0, doc_id="doc_id", text="text", source="source", most_sources: int = 1_000_000) -> DataFrame:
    """``doc_id, source, n_tokens, epoch, block, place``: each row once for every time it is drawn.

    ``n_tokens`` are words; the budget is in them and is the corpus size unless given. ``place`` is the
    block's rank in its epoch's permutation (from 0). A null source is the source ''. Texts without words
    come with their block. Repeated rows stand in one block and order by text; sources are a controlled
    vocabulary, and more than ``most_sources`` are refused rather than collected.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("source"),
                       F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_tokens"),
                       _digest(F.lit(seed), F.col(doc_id), F.md5(body.cast("binary"))).alias("h"))
    rows = stored(rows, "sizes")
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    if sums.count() > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    found = sorted((r.source, r.tokens) for r in sums.collect())
    tokens = [t for _, t in found]
    budget = sum(tokens) if budget is None else budget
    w = weights(tokens, exponent(tokens, budget, share, repeats))
    goal = [math.floor(budget * x + 0.5) for x in w.tolist()]
    plan = spark.createDataFrame([(s, max(1, -(-t // block_tokens)), g // t if t else 0, g % t if t else 0) for (s, t), g in zip(found, goal)],
                                 "source string, blocks long, whole long, rest long")
    rows = rows.join(F.broadcast(plan), "source").withColumn("block", F.col("h") % F.col("blocks"))
    # one row a block: running sums of the permuted blocks say which are whole and which is cut
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(plan), "source")
    sums = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    order = Window.partitionBy("source", "epoch").orderBy(_digest(F.lit(seed), F.col("epoch"), F.col("source"), F.col("block")), "block")
    sums = (sums.withColumn("place", F.row_number().over(order) - 1).withColumn("upto", F.sum("tokens").over(order))
            .withColumn("left", F.when(F.col("epoch") < F.col("whole"), F.col("tokens")).otherwise(F.col("rest") - F.col("upto") + F.col("tokens")))
            .filter((F.col("epoch") < F.col("whole")) | (F.col("left") > 0)).select("source", "block", "epoch", "place", "left", "tokens"))
    drawn = rows.drop("blocks", "whole", "rest").join(stored(sums, "blocks"), ["source", "block"])
    whole = drawn.filter("left >= tokens")
    inside = Window.partitionBy("source", "block", "epoch").orderBy("h", "n_tokens", "doc_id")
    cut = drawn.filter("left < tokens").withColumn("upto", F.sum("n_tokens").over(inside)).filter("upto <= left").drop("upto")
    return whole.unionByName(cut).select("doc_id", "source", "n_tokens", "epoch", "block", "place")
