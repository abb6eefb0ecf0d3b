"""Accumulated maps on disk: a table of what each batch of each stream saw of each (voxel, frame).

A batch writes its own part and nothing else, so a repeated batch replaces itself and the cost of a
batch does not grow with the map. Parts of one frame add up, however many batches of a stream it
came in. A frame that a second stream brings too (say, one restarted without its checkpoint after the
first died in the middle of the frame) belongs to the stream that brought the most of it; what the
others saw of a voxel counts once with it, their votes and colour only where it has nothing there.
Folding frames away closes them.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.evidence import CELL, VOXEL, blind_claim, claim_of, latest_colour, measured_state, verdicts, with_class
from voxmill.plans.blocks import growing
from voxmill.schema import N_CLASSES

VOTES = [f"v{c}" for c in range(1, N_CLASSES)]
SUMS = ["n_hit", "n_pass", "n_seen", *VOTES]
FIRSTS = ["first_touch", "first_pred"]
RGB = ["r", "g", "b"]
PART = ("room int, ix int, iy int, iz int, frame int, hit int, seen int, " + ", ".join(f"{c} long" for c in VOTES)
        + ", lit long, " + ", ".join(f"{c} double" for c in RGB) + ", stream string, batch long")
BASE = ("room int, ix int, iy int, iz int, " + ", ".join(f"{c} long" for c in SUMS) + ", " + ", ".join(f"{c} int" for c in FIRSTS)
        + ", colour_n long, " + ", ".join(f"{c} double" for c in RGB))


def upgrade(old: DataFrame) -> DataFrame:
    """Maps written when colour was a sum over pixels: recover the mean it stood for."""
    has = "colour_sum_r" in old.columns
    if not has:
        return old
    n = F.greatest(F.col("colour_n"), F.lit(1))
    new = old.select("*", *[F.coalesce(F.col(c), F.col(f"colour_sum_{c}") / n).alias(c + "_") for c in "rgb"])
    return (new.drop("r", "g", "b", *[f"colour_sum_{c}" for c in "rgb"])
            .withColumnsRenamed({c + "_": c for c in "rgb"}).withColumn("colour_n", (F.col("colour_n") > 0).cast("int")))


def _votes():
    return sum((F.col(v) for v in VOTES[1:]), F.col(VOTES[0]))


def _added(counts: DataFrame) -> DataFrame:
    """Rows of counts of a voxel put together."""
    return counts.groupBy(*VOXEL).agg(*[F.sum(s).alias(s) for s in SUMS], *[F.min(f).alias(f) for f in FIRSTS])


class MapStore:
    """Evidence and claims of rooms under one folder; ``create`` it once before the first use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> "MapStore":
        """Lay down the empty tables. A store that holds something is refused."""
        for kind, ddl in (("parts/stream=none/batch=-1", PART.rsplit(", stream", 1)[0]), ("base", BASE), ("closed", "upto int")):
            self.spark.createDataFrame([], ddl).write.mode("errorifexists").parquet(f"{self.path}/{kind}")
        return self

    def _read(self, kind: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{kind}")

    def merge(self, evidence: DataFrame, claims: DataFrame, batch: int, stream: str = "main") -> None:
        """Add one batch of a stream. Colour is that of hits, where the evidence has ``r, g, b``."""
        has = all(c in evidence.columns for c in RGB)
        rgb = [(F.when(F.col("kind") == "hit", F.col(c)) if has else F.lit(None)).cast("double").alias(c) for c in RGB]
        none = [F.lit(None).cast("double").alias(c) for c in RGB]
        e = evidence.filter("kind IN ('hit', 'pass')").select(*VOXEL, "frame", (F.col("kind") == "hit").cast("int").alias("hit"), F.lit(None).cast("int").alias("cls"), *rgb)
        c = claims.select(*VOXEL, "frame", F.lit(None).cast("int").alias("hit"), "cls", *none)
        part = e.unionByName(c).groupBy(*VOXEL, "frame").agg(
            F.max("hit").alias("hit"), F.max(F.col("cls").isNotNull().cast("int")).alias("seen"),
            *[F.count_if(F.col("cls") == k).alias(f"v{k}") for k in range(1, N_CLASSES)], F.count("r").alias("lit"), *[F.sum(x).alias(x) for x in RGB])
        part.write.mode("overwrite").parquet(f"{self.path}/parts/stream={stream}/batch={batch}")

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """Rows of open frames, ``main`` where they are of the frame's own stream, and (room, frame, stream, batch) of all
        that the map could do without: parts of closed frames, and of other streams."""
        parts = self._read("parts", PART)
        closed = self._read("closed", "upto int").agg(F.coalesce(F.max("upto"), F.lit(-(1 << 31))).alias("upto"))
        came = parts.groupBy("room", "frame", "stream", "batch").agg(F.count(F.lit(1)).alias("n"))
        # the most rows, then the first by name
        owner = came.groupBy("room", "frame", "stream").agg(F.sum("n").alias("n"))
        owner = owner.groupBy("room", "frame").agg(F.min(F.struct(-F.col("n"), "stream"))["stream"].alias("owner"))
        late = came.join(growing(owner), ["room", "frame"]).crossJoin(F.broadcast(closed)).filter("stream <> owner OR frame <= upto")
        parts = parts.join(growing(owner), ["room", "frame"]).crossJoin(F.broadcast(closed)).filter("frame > upto")
        return parts.withColumn("main", F.col("stream") == F.col("owner")).drop("owner", "upto"), late.select("room", "frame", "stream", "batch")

    def frames(self) -> DataFrame:
        """``room, frame`` of every frame that is not folded away."""
        return self._parts()[0].select("room", "frame").distinct()

    def late(self) -> DataFrame:
        return self._parts()[1]

    def _seen(self) -> DataFrame:
        """One row per (voxel, frame): a stream's parts added up, then the streams put together."""
        sums = [*VOTES, "lit", *RGB]
        each = self._parts()[0].groupBy(*VOXEL, "frame", "stream").agg(
            F.max("hit").alias("hit"), F.max("seen").alias("seen"), F.max("main").alias("main"), *[F.sum(c).alias(c) for c in sums])
        # the frame's own stream first, then the one that has the most here, then the first by name
        rank = F.struct(~F.col("main"), -(F.col("lit") + _votes()), "stream")
        best = each.groupBy(*VOXEL, "frame").agg(F.max("hit").alias("hit"), F.max("seen").alias("seen"), F.min_by(F.struct(*sums), rank).alias("s"))
        return best.select(*VOXEL, "frame", "hit", "seen", "s.*")

    def _sums(self, seen: DataFrame) -> DataFrame:
        """Counts of each voxel, with what was folded away."""
        claimed = _votes() > 0
        fresh = seen.groupBy(*VOXEL).agg(
            F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"), F.coalesce(F.sum(1 - F.col("hit")), F.lit(0)).alias("n_pass"),
            F.sum("seen").alias("n_seen"), *[F.sum(v).alias(v) for v in VOTES],
            F.min(F.when(F.col("hit").isNotNull(), F.col("frame"))).alias("first_touch"), F.min(F.when(claimed, F.col("frame"))).alias("first_pred"))
        return _added(fresh.unionByName(self._read("base", BASE).select(*VOXEL, *SUMS, *FIRSTS)))

    def _changed(self, stream: str, since: int) -> DataFrame:
        """What a store's only stream added after the batch ``since`` to the counts of the voxels it touched. Parts up to then are
        read only where they have frames that came again."""
        closed = self._read("closed", "upto int").agg(F.coalesce(F.max("upto"), F.lit(-(1 << 31)))).first()[0]
        parts = self._read("parts", PART).filter((F.col("stream") == stream) & (F.col("frame") > closed)).dropna(subset=VOXEL)
        new = parts.filter(F.col("batch") > since)
        low, top = new.agg(F.min("frame"), F.max("frame")).first()
        rows = new.unionByName(parts.filter((F.col("batch") <= since) & F.col("frame").between(low, top))) if low is not None else new
        fresh = F.col("batch") > since
        seen = rows.groupBy(*VOXEL, "frame").agg(
            F.max("hit").alias("hit"), F.max("seen").alias("seen"), F.max(F.when(~fresh, F.col("hit"))).alias("hit0"),
            F.coalesce(F.max(F.when(~fresh, F.col("seen"))), F.lit(0)).alias("seen0"), F.max(fresh).alias("fresh"),
            *[F.sum(F.when(fresh, F.col(v)).otherwise(0)).alias(v) for v in VOTES]).filter("fresh")
        more = lambda value: (F.coalesce(F.col("hit") == value, F.lit(False)).cast("long") - F.coalesce(F.col("hit0") == value, F.lit(False)).cast("long"))
        return seen.groupBy(*VOXEL).agg(
            F.sum(more(1)).alias("n_hit"), F.sum(more(0)).alias("n_pass"), F.sum(F.col("seen") - F.col("seen0")).alias("n_seen"), *[F.sum(v).alias(v) for v in VOTES],
            F.min(F.when(F.col("hit").isNotNull(), F.col("frame"))).alias("first_touch"), F.min(F.when(_votes() > 0, F.col("frame"))).alias("first_pred"))

    def _before(self, path: str, ddl: str, batch: int) -> tuple[DataFrame, int]:
        """The counts after a batch, if they are there, else what was folded away; and the batch they go up to."""
        try:
            counts = self.spark.read.schema(ddl).parquet(path).filter(F.col("upto") == batch)
            if not counts.isEmpty():
                return counts, batch
        except AnalysisException:
            pass
        return self._read("base", BASE), -1

    def world_after(self, batch: int, stream: str) -> DataFrame:
        """The map without colour after a stream's newest batch, from its counts after the batch before.

        Counts lie in two folders by turns, so a batch reads what it brought and one row a voxel, and a repeated batch
        finds those before it. A first batch, and a store that other streams write too, are counted from all parts."""
        at = lambda b: f"{self.path}/counts/stream={stream}/turn={b % 2}"
        ddl = BASE.split(", colour_n")[0] + ", upto long"
        others = {f.split("/stream=")[1].split("/")[0] for f in self._read("parts", PART).inputFiles()} - {"none", stream}
        if others:
            now = self._sums(self._seen()).dropna(subset=VOXEL)
        else:
            before, since = self._before(at(batch - 1), ddl, batch - 1)
            now = _added(before.select(*VOXEL, *SUMS, *FIRSTS).unionByName(self._changed(stream, since)))
        now = now.select(*VOXEL, *[F.col(s).cast("long").alias(s) for s in SUMS], *[F.col(f).cast("int").alias(f) for f in FIRSTS], F.lit(batch).cast("long").alias("upto"))
        now.write.mode("overwrite").parquet(at(batch))
        occupied, cls = claim_of()
        counts = self.spark.read.schema(ddl).parquet(at(batch)).drop("upto")
        return verdicts(counts.withColumns({"predicted": occupied, "cls": cls, "blind": blind_claim(), "state": measured_state(F.col("n_hit"), F.col("n_pass"))}))

    def totals(self, upto: int | None = None) -> DataFrame:
        seen = self._seen()
        if upto is not None:
            seen = seen.filter(F.col("frame") <= upto)
        sums, base = self._sums(seen), self._read("base", BASE)
        # what was folded away stands as one earlier look: the average that the later ones move
        old = base.filter("colour_n > 0").select(*VOXEL, F.lit(-1).alias("frame"), *RGB)
        looks = seen.filter("lit > 0").select(*VOXEL, "frame", *[(F.col(c) / F.col("lit")).alias(c) for c in RGB])
        looks = old.unionByName(looks).withColumn("kind", F.lit("hit"))
        before = base.select(*VOXEL, F.when(F.col("colour_n") > 0, F.col("colour_n") - 1).alias("more_"))
        colour = latest_colour(looks).join(growing(before), VOXEL, "left").withColumn("colour_n", F.col("colour_n") + F.coalesce("more_", F.lit(0))).drop("more_")
        return sums.join(growing(colour), VOXEL, "left").withColumn("colour_n", F.coalesce("colour_n", F.lit(0)))

    def world(self) -> DataFrame:
        """The map with state, claim, blind flag, verdicts and colour."""
        t = self.totals()
        c = with_class(t.select(*VOXEL, "n_seen", "first_pred", *VOTES)).drop("n_seen", "first_pred")
        blind = F.col("first_pred").isNotNull() & (F.col("first_touch").isNull() | (F.col("first_touch") > F.col("first_pred")))
        return verdicts(t.join(growing(c), VOXEL).withColumn("blind", blind).withColumn("state", measured_state(F.col("n_hit"), F.col("n_pass"))))

    def compact(self, target: str, upto: int) -> "MapStore":
        """A fresh store with the frames up to ``upto`` (not negative) folded into one row a voxel and closed.

        Later frames are copied as they are; this store is left alone."""
        new = MapStore(self.spark, target)
        totals = self.totals(upto).select(*VOXEL, *[F.col(s).cast("long").alias(s) for s in SUMS], *[F.col(f).cast("int").alias(f) for f in FIRSTS],
                                          F.col("colour_n").cast("long").alias("colour_n"), *RGB)
        totals.write.mode("errorifexists").parquet(f"{new.path}/base")
        self.spark.createDataFrame([(upto,)], "upto int").write.mode("errorifexists").parquet(f"{new.path}/closed")
        left = self._parts()[0].filter(F.col("frame") > upto).drop("main")
        left.write.partitionBy("stream", "batch").mode("errorifexists").parquet(f"{new.path}/parts")
        self.spark.createDataFrame([], PART.rsplit(", stream", 1)[0]).write.parquet(f"{new.path}/parts/stream=none/batch=-1")
        return new


__all__ = ["MapStore", "upgrade", "CELL"]
