"""Canonical table schemas and the fixed class tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Class ids 0..11 in order.
CLASS_NAMES = [
    "empty", "ceiling", "floor", "wall", "window", "chair",
    "bed", "sofa", "table", "tvs", "furn", "objs",
]
# Display colour of class 0..11 and, last, of the ignore slot 12.
CLASS_COLOURS = [
    (22, 191, 206), (214, 38, 40), (43, 160, 4), (158, 216, 229), (114, 158, 206),
    (204, 204, 91), (255, 186, 119), (147, 102, 188), (30, 119, 181), (188, 188, 33),
    (255, 127, 12), (196, 175, 214), (153, 153, 153),
]
# 37 raw classes of the run-length label volumes -> the 12 classes.
RAW_TO_CLASS = [
    0, 1, 2, 3, 4, 11, 5, 6, 7, 8, 8, 10, 10, 10, 11, 11, 9, 8, 11,
    11, 11, 11, 11, 11, 11, 11, 11, 10, 10, 11, 8, 10, 11, 9, 11, 11, 11,
]

N_CLASSES = 12
EMPTY, CEILING, FLOOR, WALL = 0, 1, 2, 3
IGNORE = 255
GRID_LOW = (60, 36, 60)      # (gz, gy, gx) cells of 8 cm
GRID_HIGH = (240, 144, 240)  # cells of 2 cm
VOXEL_M = 0.08

VOXELS = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("scene", T.StringType()),
    T.StructField("frame", T.StringType()), T.StructField("flat", T.IntegerType()),
    T.StructField("gz", T.IntegerType()), T.StructField("gy", T.IntegerType()),
    T.StructField("gx", T.IntegerType()), T.StructField("pred", T.IntegerType()),
    T.StructField("label", T.IntegerType()), T.StructField("label_weight", T.IntegerType()),
    T.StructField("tsdf", T.DoubleType()), T.StructField("pixel_id", T.IntegerType()),
])
TRAJECTORY = T.StructType([
    T.StructField("frame", T.IntegerType()), T.StructField("T", T.ArrayType(T.DoubleType())),
])
SCORES = T.StructType(
    [T.StructField("frame", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ("cam_z", "tilt_deg", "valid_pct", "floor_pct", "depth_med", "near_pct", "free_mean")]
    + [T.StructField("scored", T.LongType()), T.StructField("sc_voxels", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("occ_pct", "sc_iou", "margin", "ssc_miou")]
    + [T.StructField("classes", T.IntegerType())]
)
EVIDENCE = T.StructType([
    T.StructField("room", T.IntegerType()), T.StructField("frame", T.IntegerType()),
    T.StructField("ix", T.IntegerType()), T.StructField("iy", T.IntegerType()),
    T.StructField("iz", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("r", T.IntegerType()), T.StructField("ts", T.TimestampType()),
])
TRACKING = T.StructType([
    T.StructField("capture", T.IntegerType()), T.StructField("frame", T.LongType()),
    T.StructField("fitness", T.DoubleType()), T.StructField("step_m", T.DoubleType()),
    T.StructField("turn_deg", T.DoubleType()),
])


def classes(spark: SparkSession) -> DataFrame:
    """Class dimension: id, name, colour. 12 rows, always."""
    rows = [(i, n, *CLASS_COLOURS[i]) for i, n in enumerate(CLASS_NAMES)]
    return spark.createDataFrame(rows, "cls int, name string, cr int, cg int, cb int")


def raw_classes(spark: SparkSession) -> DataFrame:
    """Raw-class dimension of the run-length volumes: 37 rows and the ignore id."""
    rows = [(i, c) for i, c in enumerate(RAW_TO_CLASS)] + [(IGNORE, IGNORE)]
    return spark.createDataFrame(rows, "raw int, cls int")


def case_of(values, column):
    """``CASE`` column mapping 0..n-1 to a fixed list, so no join is needed."""
    from pyspark.sql import functions as F
    return F.element_at(F.array(*[F.lit(v) for v in values]), column + 1)
