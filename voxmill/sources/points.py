"""Point and JSON files as a data source with commit: one whole file a frame or room, or none at all."""

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from voxmill.sources.text import HEADER

CHUNK = 1 << 20
MISSING = "__HIVE_DEFAULT_PARTITION__"  # names the file of a key that is null, as in Spark's folders


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task has filled, or an empty name."""

    folder: str


class PointWriter(DataSourceArrowWriter):
    """Writes rows (key, value) that come sorted by key; a task stages its files in a folder of its own.

    With ``kind`` "ply" a file has the header of a point file."""

    def __init__(self, root: str, overwrite: bool, kind: str = "ply"):
        self.root, self.overwrite, self.kind, self.job = root.rstrip("/"), overwrite, kind, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        store, base = fs.FileSystem.from_uri(self.root)
        name = f"part-{uuid.uuid4().hex}"
        folder, key, body, n = f"{base}/_staging-{self.job}/{name}", None, None, 0

        def close():
            title = quote(str(key), safe="")
            if title.startswith(("_", ".")):  # readers pass over such files
                title = f"%{ord(title[0]):02X}{title[1:]}"
            spot = f"{folder}/{title}.{self.kind}"
            with body, store.open_output_stream(spot, compression=None) as out:
                if self.kind == "ply":
                    out.write("".join(f"{h} {n}\n" if h == "element vertex" else f"{h}\n" for h in HEADER).encode())
                body.seek(0)
                while part := body.read(CHUNK):
                    out.write(part)

        for batch in batches:
            keys = batch.column(0).dictionary_encode("encode")
            first = np.flatnonzero(np.diff(keys.indices.to_numpy(), prepend=-1))
            for at, end in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
                k = keys[at].as_py()
                if body is None or k != key:
                    if body is None:
                        store.create_dir(folder, recursive=True)
                    else:
                        close()
                    # the count stands before the lines, which wait in memory, or in a file of the task if there are many
                    key, n, body = k, 0, tempfile.SpooledTemporaryFile(max_size=8 * CHUNK)
                body.write("".join([f"{v}\n" for v in batch.column(1).slice(at, end - at).to_pylist()]).encode())
                n += end - at
        if body is None:
            return Staged("")
        close()
        return Staged(name)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        store.create_dir(base, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base)):
                if old.base_name.startswith("part-"):
                    store.delete_dir(old.path)
                elif old.base_name == "_SUCCESS":
                    store.delete_file(old.path)
        for message in messages:
            if message is not None and message.folder:
                store.move(f"{base}/_staging-{self.job}/{message.folder}", f"{base}/{message.folder}")
        self._unstage(store, base)
        store.open_output_stream(f"{base}/_SUCCESS", compression=None).close()

    def abort(self, messages: list[Staged | None]) -> None:
        self._unstage(*fs.FileSystem.from_uri(self.root))

    def _unstage(self, store, base: str) -> None:
        """Folders of tasks that were tried again go too."""
        at = f"{base}/_staging-{self.job}"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class PointFiles(DataSource):
    """``format("voxmill_points")``: rows (key, value) into ``<path>/part-*/<key>.ply``."""

    @classmethod
    def name(cls) -> str:
        return "voxmill_points"

    def writer(self, schema, overwrite: bool) -> PointWriter:
        return PointWriter(self.options["path"], overwrite, self.options.get("kind", "ply"))


def _write(rows: DataFrame, root: str, kind: str) -> None:
    rows.sparkSession.dataSource.register(PointFiles)
    rows.select("key", "value").write.format("voxmill_points").option("kind", kind).mode("overwrite").save(root)


def write_point_files(points: DataFrame, root: str, key: str, order: Column) -> None:
    """One file for each ``key`` of ``points`` (key, value), lines in ``order``. A key is one frame or room, which bounds its file.

    Files appear below ``root`` when all tasks are done, and ``_SUCCESS`` after them; a failed write leaves nothing."""
    rows = points.select(F.col(key).cast("string").alias("key"), "value", order.alias("at"))
    _write(rows.repartition("key").sortWithinPartitions("key", "at"), root, "ply")


def write_documents(docs: DataFrame, root: str, key: str) -> None:
    """One JSON file for each ``key`` of ``docs`` (key, value), with the commit of point files: a folder a task, not one a key."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit(MISSING)).alias("key"), "value")
    _write(rows.repartition("key").sortWithinPartitions("key"), root, "json")


def _key(kind: str) -> Column:
    """The key that a file is named by: written once by us and once as a URI, where it needs that."""
    name = F.substring_index(F.input_file_name(), "/", -1)
    name = F.substring(name, F.lit(1), F.length(name) - len(kind) - 1)
    return F.when(name.contains("%"), F.url_decode(F.url_decode(name))).otherwise(name)


def read_point_files(spark: SparkSession, root: str) -> DataFrame:
    """``key, value``: the lines of all files below ``root``, with the name of their file."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ply").text(root)
    return lines.select(_key("ply").alias("key"), "value")


def read_document_files(spark: SparkSession, root: str) -> DataFrame:
    """``file, key, value``: the whole of each document below ``root``, with the name of its file."""
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    return docs.select(F.input_file_name().alias("file"), F.nullif(_key("json"), F.lit(MISSING)).alias("key"), "value")
