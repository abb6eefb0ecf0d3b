"""A folder of recorded frames as a stream: in order of names, so often over, as fast as a camera."""

import json
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Piece(InputPartition):
    """One file of one round."""

    def __init__(self, path: str, place: int, turn: int):
        self.path, self.place, self.turn = path, place, turn


class ReplayReader(DataSourceStreamReader):
    """Offsets count files over all rounds; the clock lets ``fps`` of them go a second."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.columns = options["path"].rstrip("/"), [c for c in schema.names if c not in ("place", "turn")]
        self.rounds, self.fps, self.clock = int(options.get("rounds", "1")), float(options.get("fps", "0")), options.get("clock")
        store, base = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        self.files = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet"))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        total = len(self.files) * self.rounds
        return {"files": total if not self.fps else min(total, int((time.time() - self._began()) * self.fps) + 1)}

    def _began(self) -> float:
        """When the replay was first started, kept beside it: after a restart it goes on as a camera would have."""
        if self.clock is None:
            raise ValueError("a replay at a rate needs a clock: the name of a file for its start time")
        store, at = fs.FileSystem.from_uri(self.clock)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(at, compression=None) as out:
                out.write(json.dumps({"began": time.time()}).encode())
        with store.open_input_stream(at, compression=None) as text:
            return json.loads(text.read())["began"]

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(self.files[i % len(self.files)], i % len(self.files), i // len(self.files)) for i in range(start["files"], end["files"])]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.root)
        with store.open_input_file(piece.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=self.columns):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in self.columns], pa.array([piece.place] * n, pa.int32()), pa.array([piece.turn] * n, pa.int32())],
                                                 names=[*self.columns, "place", "turn"])

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    """``format("voxmill_replay")`` with ``path`` and, at will, ``rounds``, ``fps`` and ``clock``."""

    @classmethod
    def name(cls) -> str:
        return "voxmill_replay"

    def streamReader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(self.options, schema)


def replay(spark: SparkSession, folder: str, schema: str, rounds: int = 1, fps: float = 0.0, clock: str | None = None) -> DataFrame:
    """The parquet files of ``folder`` (a URI that all executors reach) as a stream, with ``place`` (of the file) and ``turn``."""
    spark.dataSource.register(Replay)
    r = spark.readStream.format("voxmill_replay").schema(f"{schema}, place int, turn int").option("rounds", rounds).option("fps", fps)
    return (r.option("clock", clock) if clock else r).load(folder)
