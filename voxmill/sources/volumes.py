"""Per-frame binary volumes to voxel rows."""

import io
import struct
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.schema import IGNORE, RAW_TO_CLASS, case_of

RAW_ROWS = "file string, frame string, flat int, value double"
KINDS = ("pred", "label", "tsdf", "mapping")


def read_binary(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below a folder."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(folder).select("path", "content"))


def write_binary(files: DataFrame, root: str) -> DataFrame:
    """Write each (path, content) below ``root``, a URI all executors share; one row of path and size a file.

    A file is written beside its place and moved there, so a repeated task leaves whole files."""
    def write(batches):
        store, base = fs.FileSystem.from_uri(root)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                at = f"{base}/{path.lstrip('/')}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content)
                store.move(part, at)
            yield pd.DataFrame({"path": pdf["path"], "size": pdf["content"].map(len)})
    return files.mapInPandas(write, "path string, size long")


def volume_rows(files: DataFrame, array: str = "arr_0") -> DataFrame:
    """One row per cell of each npy/npz volume. Files are decoded where Spark reads them; a file
    is one frame, so a task holds one frame's array at a time."""
    def decode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                arr = np.asarray(got[array] if hasattr(got, "files") else got).reshape(-1)
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame({"file": path, "frame": name, "flat": np.arange(arr.size, dtype=np.int32),
                                    "value": arr.astype(np.float64)})
    return files.mapInPandas(decode, RAW_ROWS)


def complete_frames(lists: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Frames present in every list, and those missing from at least one with what they have.

    ``lists`` maps a kind to a DataFrame with a ``frame`` column."""
    rows = None
    for kind, df in lists.items():
        one = df.select("frame").distinct().withColumn("kind", F.lit(kind))
        rows = one if rows is None else rows.unionByName(one)
    have = rows.groupBy("frame").agg(F.array_sort(F.collect_set("kind")).alias("have"))  # <= one entry per kind
    full = F.size("have") == len(lists)
    return have.filter(full).select("frame"), have.filter(~full)


def voxel_table(rows: DataFrame, weight: DataFrame | None = None, sentinel: int = 307200) -> DataFrame:
    """Turn the parallel volumes of each frame into voxel rows; a frame missing one is skipped.

    ``rows`` are those of ``volume_rows`` for files in folders named pred, label, tsdf and mapping,
    each decoded once. One shuffle on (frame, flat) spreads a frame's cells over tasks."""
    kind = F.element_at(F.split("file", "/"), -2)
    if weight is not None:
        rows = rows.unionByName(weight)
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    out = rows.withColumn("kind", kind).groupBy("frame", "flat").agg(*[of(k) for k in KINDS], of("label_weight"))
    needed = KINDS if weight is None else (*KINDS, "label_weight")
    out = out.filter(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in needed]))
    flat = F.col("flat")
    return out.select("frame", "flat", F.floor(flat / 2160).cast("int").alias("gz"), (F.floor(flat / 60) % 36).cast("int").alias("gy"),
                      (flat % 60).alias("gx"), F.col("pred").cast("int").alias("pred"), F.col("label").cast("int").alias("label"),
                      F.col("label_weight").cast("int").alias("label_weight"), "tsdf",
                      F.when(F.col("mapping") != sentinel, F.col("mapping").cast("int")).alias("pixel_id"))


def label_runs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run-length label files -> (headers, runs): origin and pose, and (file, seq, raw, count)."""
    def runs(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                v = np.frombuffer(content[76:], np.uint32)
                yield pd.DataFrame({"file": path, "seq": np.arange(len(v) // 2, dtype=np.int32),
                                    "raw": v[0::2].astype(np.int32), "count": v[1::2].astype(np.int32)})

    def heads(batches):
        for pdf in batches:
            got = [(p, *[list(x) for x in (struct.unpack("3f", c[:12]), struct.unpack("16f", c[12:76]))])
                   for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(got, columns=["file", "vox_origin", "T"])

    return (files.mapInPandas(heads, "file string, vox_origin array<double>, T array<double>"),
            files.mapInPandas(runs, "file string, seq int, raw int, count int"))


def expand_runs(runs: DataFrame, key: str = "file") -> DataFrame:
    """Runs -> one row per cell with the 12-class label; 255 stays 255.

    A volume has a fixed number of cells, which bounds the runs of a file and so its window."""
    upto = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    placed = runs.filter("count > 0").withColumn("start", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    cls = F.when(F.col("raw") == IGNORE, IGNORE).otherwise(case_of(RAW_TO_CLASS, F.col("raw") % 37))
    return placed.select(key, cls.alias("label"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("flat"))
