"""Ordered series without ordering a whole series in one task.

A capture may hold a third of all rows, so nothing here windows over a whole
capture. Rows are cut into blocks of the order column (``floor(order / width)``,
the same on every run), each block is windowed alone, and what crosses block
edges travels as one small row per block, itself summed in two levels.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAN = 4096


def growing(df: DataFrame) -> DataFrame:
    """A table that grows with the input, for the other side of an equi-join: both sides are shuffled and sorted.

    Spark would broadcast it through the driver as long as its compressed shuffle files look small,
    which they do at several times the driver's share of memory."""
    return df.hint("merge")


def block_prefix(blocks: DataFrame, keys: list[str], block: str, value: str, out: str, how=F.sum, start=0) -> DataFrame:
    """Running ``how`` of ``value`` over the earlier blocks of each key, ``start`` before the first.

    ``blocks`` has one row per (key, block). Super-blocks of FAN blocks keep both
    windows short. ``how`` is F.sum, F.max or F.min."""
    b = blocks.withColumn("super_", F.floor(F.col(block) / FAN))
    tops = b.groupBy(*keys, "super_").agg(how(value).alias("s_"))
    before = W.partitionBy(*keys).orderBy("super_").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*keys, "super_", how("s_").over(before).alias("top_"))
    inner = W.partitionBy(*keys, "super_").orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    join = (lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))) if how is F.sum else (F.greatest if how is F.max else F.least)
    return (b.withColumn("in_", how(value).over(inner)).join(growing(tops), keys + ["super_"])
            .withColumn(out, F.coalesce(join(F.col("in_"), F.col("top_")), F.lit(start))).drop("super_", "in_", "top_"))


def ordered(column: str) -> Column:
    """The column, or an error: a row without a place in the order can neither be indexed nor dropped."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"a row has no {column}, the order of its series")).cast("long"))


def row_index(df: DataFrame, keys: list[str], order: str, width: float, out: str = "rn") -> DataFrame:
    """Contiguous 0-based index of each row within its key, by ``order``.

    ``order`` must be unique within a key. A block then has at most ``width`` rows
    for an integer order, or rate x width for a time. A NULL order is an error."""
    b = df.withColumn("blk_", F.floor(ordered(order) / F.lit(width)))
    counts = b.groupBy(*keys, "blk_").agg(F.count(F.lit(1)).alias("n_"))
    offs = block_prefix(counts, keys, "blk_", "n_", "off_").select(*keys, "blk_", "off_")
    inner = W.partitionBy(*keys, "blk_").orderBy(order)
    local = b.withColumn("loc_", F.row_number().over(inner) - 1)
    return (local.join(offs, keys + ["blk_"]).withColumn(out, F.col("off_") + F.col("loc_"))
            .drop("blk_", "loc_", "off_"))


def running(df: DataFrame, keys: list[str], index: str, value: Column, out: str, width: int = FAN,
            how=F.sum, inclusive: bool = True) -> DataFrame:
    """Running sum, max or min along an integer order, up to and including each row or before it."""
    b = df.withColumn("blk_", F.floor(ordered(index) / width)).withColumn("val_", value)
    per = b.groupBy(*keys, "blk_").agg(how("val_").alias("s_"))
    start = 0 if how is F.sum else None
    offs = block_prefix(per, keys, "blk_", "s_", "off_", how, start).select(*keys, "blk_", "off_")
    inner = W.partitionBy(*keys, "blk_").orderBy(index).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    j = b.withColumn("run_", how("val_").over(inner)).join(offs, keys + ["blk_"])
    both = (F.col("off_") + F.coalesce("run_", F.lit(0)) if how is F.sum
            else (F.greatest if how is F.max else F.least)("off_", "run_"))
    return j.withColumn(out, both).drop("blk_", "val_", "run_", "off_")


def halo(df: DataFrame, index: str, before: int, after: int, width: int = FAN) -> DataFrame:
    """Give each block copies of the ``before`` rows ahead of it and ``after`` rows behind it.

    Adds ``blk_`` and ``own_``: window over (keys, blk_), then keep ``own_`` rows."""
    if max(before, after) > width:
        raise ValueError("halo wider than a block")
    i = F.col(index)
    home = F.floor(i / width)
    spots = [F.struct(home.alias("blk_"), F.lit(True).alias("own_"))]
    if before:
        spots.append(F.when(i % width >= width - before, F.struct((home + 1).alias("blk_"), F.lit(False).alias("own_"))))
    if after:
        spots.append(F.when((i % width < after) & (home > 0), F.struct((home - 1).alias("blk_"), F.lit(False).alias("own_"))))
    return df.select("*", F.inline(F.filter(F.array(*spots), lambda s: s.isNotNull())))


def near_window(df: DataFrame, keys: list[str], index: str, before: int, after: int,
                cols: dict, width: int = FAN) -> DataFrame:
    """Evaluate window columns that look at most ``before``/``after`` rows away.

    ``cols`` maps a name to a function of the ordered window spec."""
    w = W.partitionBy(*keys, "blk_").orderBy(index)
    out = halo(df, index, before, after, width)
    out = out.select("*", *[fn(w).alias(name) for name, fn in cols.items()])
    return out.filter("own_").drop("blk_", "own_")


def global_index(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """0-based index of each row in a total order over any column types.

    Rows are range-partitioned and sorted, stored once (so the split is the same for the
    counts and the rows, whatever is lost), and each partition is offset by the sizes of
    those before it: one small row per partition."""
    from voxmill.session import cut
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id()))
    part = F.shiftright("id_", 33)
    sizes = stored.groupBy(part.alias("p_")).agg(F.count(F.lit(1)).alias("n_"))
    upto = W.orderBy("p_").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offs = sizes.select("p_", F.coalesce(F.sum("n_").over(upto), F.lit(0)).alias("off_"))
    return (stored.withColumn("p_", part).join(F.broadcast(offs), "p_")
            .withColumn(out, F.col("off_") + F.col("id_").bitwiseAND((1 << 33) - 1)).drop("p_", "id_", "off_"))
