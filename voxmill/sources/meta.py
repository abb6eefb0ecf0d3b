"""JSON sources: capture metadata and annotation solids."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.geometry import ROT
from voxmill.schema import CLASS_NAMES

ONE = "camera_height double, yaw double, up_camera array<double>, cam_K array<array<double>>"
META = f"struct<camera_height:double,yaw:double,up_camera:array<double>,cam_K:array<array<double>>,frames:array<string>," \
       f"frame_meta:map<string,struct<camera_height:double,yaw:double,up_camera:array<double>,cam_K:array<array<double>>>>>"
SOLID = "struct<class:string,label:string,shape:string,center:array<double>,size:array<double>,yaw_deg:double,rotation:array<array<double>>>"
SOLIDS = f"struct<room:struct<center:array<double>,size:array<double>,yaw_deg:double,thickness:double,ceiling:boolean>,solids:array<{SOLID}>>"


def read_documents(spark: SparkSession, path: str, *folders: str) -> DataFrame:
    """Whole JSON files as (file, value), with the ``name=value`` folders named that they stand in."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value", *folders)


def frame_meta(docs: DataFrame, key: str, given: dict[str, Column] | None = None, default_height: float = 1.25) -> DataFrame:
    """One row per frame: a value given by the caller wins, then the frame's own, then the
    capture's, then the default."""
    d = docs.select(key, F.from_json("value", META).alias("m"))
    f = d.select(key, "m", F.explode("m.frames").alias("frame"))
    own = F.try_element_at(F.col("m.frame_meta"), F.col("frame"))
    given = given or {}
    pick = lambda c, *rest: F.coalesce(*([given[c]] if c in given else []), own[c], F.col(f"m.{c}"), *rest)
    k = pick("cam_K")
    return f.select(key, "frame", pick("camera_height", F.lit(default_height)).alias("camera_height"),
                    pick("yaw", F.lit(0.0)).alias("yaw"), pick("up_camera", F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0))).alias("up_camera"),
                    k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy"))


def solids(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Annotation solids in write order -> (rows, rejects with a reason).

    The class is a name or an id 1..11; the rotation is a matrix or a yaw."""
    d = docs.select(key, F.from_json("value", SOLIDS).alias("m")).select(key, F.posexplode("m.solids").alias("seq", "s"))
    names = F.create_map(*[x for i, n in enumerate(CLASS_NAMES) if i for x in (F.lit(n), F.lit(i))])
    said = F.coalesce(F.col("s.class"), F.col("s.label"))
    cls = F.coalesce(F.try_element_at(names, said), said.try_cast("int"))
    yaw = F.radians(F.coalesce(F.col("s.yaw_deg"), F.lit(0.0)))
    c, s, z, o = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    turned = [c, -s, z, s, c, z, z, z, o]
    given = F.col("s.rotation")
    rot = [F.coalesce(F.try_element_at(F.flatten(given), F.lit(i + 1)), turned[i]).alias(n) for i, n in enumerate(ROT)]
    rows = d.select(key, "seq", cls.alias("cls"), F.coalesce(F.col("s.shape"), F.lit("box")).alias("shape"),
                    *[F.col("s.center")[i].alias(f"c{a}") for i, a in enumerate("xyz")],
                    *[F.col("s.size")[i].alias(f"s{a}") for i, a in enumerate("xyz")], *rot)
    r = {n: F.col(n) for n in ROT}
    det = (r["r00"] * (r["r11"] * r["r22"] - r["r12"] * r["r21"]) - r["r01"] * (r["r10"] * r["r22"] - r["r12"] * r["r20"])
           + r["r02"] * (r["r10"] * r["r21"] - r["r11"] * r["r20"]))
    why = (F.when(F.col("cls").isNull() | ~F.col("cls").between(1, 11), "class")
           .when(~F.col("shape").isin("box", "cylinder", "wedge"), "shape")
           .when(F.abs(det - 1.0) > 1e-3, "rotation"))
    judged = rows.withColumn("why", why)
    return judged.filter("why IS NULL").drop("why"), judged.filter("why IS NOT NULL").select(key, "seq", "why")
