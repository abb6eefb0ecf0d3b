"""Text formats: point lists, trajectories, split lists, calibration, score files.

Each format has a parser over a DataFrame of lines (column ``value``, plus whatever names
the file) and a reader that feeds it from ``spark.read.text``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.geometry import POSE
from voxmill.schema import CLASS_COLOURS, SCORES

# Colours a settled voxel wears, in the order they are applied.
VERDICT_COLOURS = [("confirmed", (60, 220, 90)), ("disproved", (230, 60, 60)), ("missed", (70, 130, 255))]
# The header of a point file.
HEADER = ["ply", "format ascii 1.0", "element vertex", "property float x", "property float y", "property float z",
          "property uchar red", "property uchar green", "property uchar blue", "end_header"]


def read_lines(spark: SparkSession, path: str, *folders: str) -> DataFrame:
    """Lines with their file, and with the ``name=value`` folders named that they stand in."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"), *folders)


def numbers(value: Column) -> Column:
    return F.transform(F.split(F.trim(value), r"\s+"), lambda x: x.cast("double"))


# ---- points ------------------------------------------------------------------

def class_of_colour(r: Column, g: Column, b: Column) -> Column:
    """Class of an exact display colour, 12 for the ignore colour, -1 when unknown."""
    table = F.create_map(*[x for i, (cr, cg, cb) in enumerate(CLASS_COLOURS) for x in (F.lit(cr * 65536 + cg * 256 + cb), F.lit(i))])
    return F.coalesce(F.try_element_at(table, r * 65536 + g * 256 + b), F.lit(-1))


def is_point(value: Column) -> Column:
    return value.rlike(r"^\s*-?[0-9]")


def parse_points(lines: DataFrame, *keys: str) -> DataFrame:
    """Point lines -> grid index, colour and class; header lines fall out."""
    n = lines.filter(is_point(F.col("value"))).select(*keys, numbers(F.col("value")).alias("n"))
    whole = [F.rint(F.col("n")[i]).cast("int") for i in range(6)]
    p = n.select(*keys, *[c.alias(a) for c, a in zip(whole, ("ix", "iy", "iz", "r", "g", "b"))])
    return p.withColumn("cls", class_of_colour(F.col("r"), F.col("g"), F.col("b")))


def colour_column(cls: Column) -> list[Column]:
    return [F.element_at(F.array(*[F.lit(c[i]) for c in CLASS_COLOURS]), cls + 1) for i in range(3)]


def point_lines(points: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, is_body, pos, value): header lines with the point count, then the body in order.

    ``points`` carries key and ``value``."""
    n = points.groupBy(key).agg(F.count(F.lit(1)).alias("n_"))
    head = n.select(key, F.posexplode(F.array(*[F.concat(F.lit(h + " "), F.col("n_").cast("string")) if h == "element vertex" else F.lit(h)
                                                for h in HEADER])).alias("pos", "value"))
    return (head.select(key, F.lit(0).alias("is_body"), F.col("pos").cast("long").alias("pos"), "value")
            .unionByName(points.select(key, F.lit(1).alias("is_body"), order.cast("long").alias("pos"), "value")))


def voxel_lines(vox: DataFrame, key: str, shown: Column) -> DataFrame:
    """Labelled voxels as point lines with their header."""
    return point_lines(voxel_body(vox, key, shown), key, F.col("at"))


def voxel_body(vox: DataFrame, key: str, shown: Column) -> DataFrame:
    """(key, at, value): hidden and unannotated cells left out, class colour."""
    cls = F.when(shown & (F.col("pred") != 255), F.col("pred")).otherwise(0)
    v = vox.withColumn("cls_", cls).filter("cls_ > 0")
    return v.select(key, F.col("flat").alias("at"), F.concat_ws(" ", "gz", "gy", "gx", *colour_column(F.col("cls_"))).alias("value"))


def world_lines(world: DataFrame, origin: tuple, unit: float, key: str = "room") -> DataFrame:
    """A world map as point lines in metres with their header."""
    return point_lines(world_body(world, origin, unit, key), key, F.col("at"))


def world_body(world: DataFrame, origin: tuple, unit: float, key: str = "room") -> DataFrame:
    """(key, at, value): points in metres, measured colour over class colour, verdict colour over both."""
    w = world.filter("measured OR predicted")
    rgb = colour_column(F.col("cls"))
    out = []
    for i, c in enumerate("rgb"):
        x = F.when(F.col("measured") & F.col(c).isNotNull(), F.col(c).cast("int")).otherwise(rgb[i])
        for name, colour in VERDICT_COLOURS:
            x = F.when(F.col(name), F.lit(colour[i])).otherwise(x)
        out.append(x)
    at = [F.format_string("%.4f", o + (F.col(n) + 0.5) * unit) for o, n in zip(origin, ("ix", "iy", "iz"))]
    long = lambda n: F.col(n).cast("long")
    return w.select(key, ((long("ix") * 100000 + long("iy")) * 100000 + long("iz")).alias("at"), F.concat_ws(" ", *at, *[c.cast("string") for c in out]).alias("value"))


def write_points(lines: DataFrame, path: str, key: str) -> None:
    """One folder per key, lines in order. A key is one frame or room, which bounds its file."""
    (lines.repartition(key).sortWithinPartitions(key, "is_body", "pos").select(key, "value")
     .write.mode("overwrite").partitionBy(key).text(path))


# ---- trajectories, splits, calibration ----------------------------------------

def parse_trajectory(lines: DataFrame, *keys: str) -> DataFrame:
    """``frame`` and sixteen floats per line; comments and blank lines dropped."""
    n = (lines.filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
         .select(*keys, numbers(F.col("value")).alias("n")).filter(F.size("n") >= 17))
    return n.select(*keys, F.col("n")[0].cast("int").alias("frame"), F.slice("n", 2, 16).alias("T"))


def trajectory_lines(traj: DataFrame, *keys: str) -> DataFrame:
    """Twelve pose columns -> one text line per frame."""
    row = [F.col(c) if c in POSE else F.lit(x) for c, x in
           [("r00", 0), ("r01", 0), ("r02", 0), ("tx", 0), ("r10", 0), ("r11", 0), ("r12", 0), ("ty", 0), ("r20", 0), ("r21", 0), ("r22", 0), ("tz", 0),
            ("", 0.0), ("", 0.0), ("", 0.0), ("", 1.0)]]
    return traj.select(*keys, F.concat_ws(" ", F.col("frame").cast("string"), *[c.cast("string") for c in row]).alias("value"))


def parse_split(lines: DataFrame) -> DataFrame:
    """Frame ids of split lists; the split is the file's own name."""
    name = F.regexp_extract("file", r"([^/]+)\.txt$", 1)
    return lines.select(F.trim("value").alias("frame"), name.alias("split")).filter("frame <> ''")


def find_frames(wanted: DataFrame, split: DataFrame) -> DataFrame:
    """The split each wanted frame is in."""
    return wanted.join(split, "frame")


# Calibration keys read as numbers.
CALIBRATION_KEYS = ["fx_depth", "fy_depth", "mx_depth", "my_depth", "depthWidth", "depthHeight"]


def parse_calibration(lines: DataFrame, key: str) -> DataFrame:
    """``name = value`` lines -> one row per file, with an identity pose when none is given."""
    kv = lines.filter(F.col("value").contains("=")).select(
        key, F.trim(F.split("value", "=", 2)[0]).alias("k"), F.trim(F.split("value", "=", 2)[1]).alias("v"))
    wide = kv.groupBy(key).pivot("k", CALIBRATION_KEYS + ["colorToDepthExtrinsics"]).agg(F.max("v"))
    eye = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    return wide.select(key, *[F.col(c).cast("double").alias(c) for c in CALIBRATION_KEYS],
                       F.coalesce(numbers(F.col("colorToDepthExtrinsics")), eye).alias("extrinsics"))


# ---- score files ---------------------------------------------------------------

def read_scores(spark: SparkSession, path: str, schema=SCORES) -> DataFrame:
    """Score rows; an empty field is missing, ids stay text."""
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def parse_scores(lines: DataFrame, ddl: str, *keys: str) -> DataFrame:
    """Score lines without a header -> typed columns."""
    return lines.select(*keys, F.from_csv("value", ddl, {"nullValue": ""}).alias("s")).select(*keys, "s.*")


def score_lines(scores: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    return scores.select(*keys, F.to_csv(F.struct(*columns), {"nullValue": ""}).alias("value"))
