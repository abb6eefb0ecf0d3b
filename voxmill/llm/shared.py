"""What several operators of this subpackage share: scratch tables, row keys and word splitting."""

import tempfile
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six bytes, which is also how ``bytes.split()`` cuts.
SPACE = r"[\x20\x09-\x0D]+"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names.

    Only a session on one machine may do without that setting. Everything that one application
    leaves stands below ``voxmill-llm/<application id>`` and can be removed when it has ended.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='voxmill-llm-')}"
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]  # as Hadoop writes it
    return f"{base.rstrip('/')}/voxmill-llm/{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder once and read them from there: lineage ends here."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``key, doc_id, text`` and nothing else, so other columns cannot clash; null texts are empty.

    ``key`` numbers the rows, so that repeated rows and repeated or null ids stay apart.
    """
    return docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(v).alias(k) for k, v in more.items()])


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def join_copies(rows: DataFrame, told: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (key, digest, ..) with the ``columns`` that ``told`` (digest, copies, ..) has of each digest, else nulls.

    What a thousandth of all copies or more shares, so a thousand digests at most, is broadcast, and its
    rows are dealt out by their own key, which is no digest, like those without a digest.
    """
    total = told.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * 1000 >= total
    widely = told.filter(hot).select("digest", *[F.col(c).alias(f"hot_{c}") for c in columns], F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(widely), "digest", "left")
    alone = F.col("digest").isNull() | F.col("hot").isNotNull()
    rows = rows.withColumn("digest", F.when(alone, F.col("key").cast("string").cast("binary")).otherwise(F.col("digest")))
    rest = told.filter(~hot).select("digest", *[F.col(c).alias(f"own_{c}") for c in columns])
    return rows.join(rest, "digest", "left").withColumns({c: F.coalesce(f"hot_{c}", f"own_{c}") for c in columns})


class Hashes(dict):
    """word bytes -> 64-bit hash, remembered; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def utf8(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def small(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that long texts are not all unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
