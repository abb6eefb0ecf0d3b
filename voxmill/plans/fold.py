"""Order-dependent folds over long series, in rounds of doubling runs of blocks.

A rule such as "the floor is 0.6 of the median of the last 30 accepted frames" has no closed
form, but its state is small and mostly forgets. First every block is folded alone from a guessed
start. Where a start differs from the end of the block before, runs of 2, then 4, then 8 blocks are
folded in one pass each, starting from what the block before the run ended with; runs that already
agree are left alone. A rule that forgets agrees after a round or two; one that never does takes
log2(blocks) rounds. The result is the sequential one, exactly. Rows stream through a task, which
holds one state and one batch.
"""

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.session import cut


def fold_blocks(df: DataFrame, keys: list[str], index: str, inputs: list[str], start: Callable[[], dict],
                step: Callable[[dict, dict], dict], outputs: str, width: int = 4096, rounds: list[int] | None = None) -> DataFrame:
    """Fold ``step(state, row) -> output values`` along ``index`` (contiguous, from 0) per key.

    ``step`` changes ``state`` (JSON-able) in place and returns a dict with the ``outputs`` DDL
    columns. Returns keys, index and the outputs for every row, taken from the round that settled
    its block. ``rounds`` collects how many blocks each round folded."""
    at = F.col(index)
    rows = cut(df.select(*keys, index, *inputs).withColumn("blk_", F.floor(at / width)))
    schema = rows.schema
    ddl = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in [*keys, index])
    names = [c.split()[0] for c in outputs.split(",")]
    block = [*keys, "blk_"]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    first = json.dumps(start())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, None
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                run_of = (*[rec[k] for k in keys], rec["run_"])
                if run_of != here:
                    here, state = run_of, json.loads(rec["start_"])
                begin = json.dumps(state) if rec[index] % width == 0 else None
                got = step(state, rec)
                out.append((*[rec[k] for k in keys], rec[index], *[got[c] for c in names], rec["blk_"], begin, json.dumps(state) if rec["last_"] else None))
            yield pd.DataFrame(out, columns=[*keys, index, *names, "blk_", "begin_", "end_"])

    def fold(todo: DataFrame, size: int) -> DataFrame:
        """``todo``: keys, run_, start_ of the runs of ``size`` blocks to fold."""
        r = rows.withColumn("run_", F.floor(F.col("blk_") / size)).join(todo, [*keys, "run_"])
        r = r.withColumn("start_", F.when(at == F.col("run_") * size * width, F.col("start_"))).join(lasts, block)
        # by a hash of the columns: AQE drops a repartition by the very columns of a join below it, and then
        # reads the rows of that join map task by map task when it becomes a broadcast, which cuts runs apart
        r = r.withColumn("last_", at == F.col("top_")).drop("top_").repartition(n, F.xxhash64(*keys, "run_")).sortWithinPartitions(*keys, "run_", index)
        return cut(r.mapInPandas(run, f"{ddl}, {outputs}, blk_ long, begin_ string, end_ string"))

    lasts = cut(rows.groupBy(*block).agg(F.max(index).alias("top_")))
    made, size = [], 1
    todo = lasts.select(*keys, F.col("blk_").alias("run_"), F.lit(first).alias("start_"))
    known = None
    while True:
        got = fold(todo, size)
        made.append(got)
        # one small row a block: what it was folded from, what it ended with, and when
        ends = got.groupBy(*block).agg(F.max("begin_").alias("begin_"), F.max("end_").alias("end_")).withColumn("round_", F.lit(len(made) - 1))
        known = cut(ends if known is None else known.join(ends.select(*block), block, "left_anti").unionByName(ends))
        if rounds is not None:
            rounds.append(ends.count())
        before = known.select(*keys, (F.col("blk_") + 1).alias("blk_"), F.col("end_").alias("want_"))
        wrong = known.join(before, block, "left").filter(F.coalesce("want_", F.lit(first)) != F.col("begin_"))
        size *= 2
        todo = wrong.select(*keys, F.floor(F.col("blk_") / size).alias("run_")).distinct().withColumn("blk_", F.col("run_") * size)
        todo = cut(todo.join(before, block, "left").select(*keys, "run_", F.coalesce("want_", F.lit(first)).alias("start_")))
        if todo.isEmpty():
            break
    when = known.select(*block, "round_")
    out = [g.join(when.filter(F.col("round_") == i), block, "left_semi").select(*keys, index, *names) for i, g in enumerate(made)]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
