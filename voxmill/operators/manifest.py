"""File manifests, packs and batches as tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.plans.blocks import FAN, global_index, halo, running
from voxmill.session import cut


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of every file below a folder, contents unread."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(folder).select("path", F.col("length").alias("size"), "modificationTime"))


def like_any(path: Column, patterns: list[str]) -> Column:
    """Shell-style patterns (``*`` and ``?``, over the whole relative path)."""
    out = F.lit(False)
    for p in patterns:
        rx = "".join({"*": ".*", "?": "."}.get(ch, "\\" + ch if ch in ".+()[]{}^$|\\" else ch) for ch in p)
        out = out | path.rlike(f"^{rx}$")
    return out


def manifest(files: DataFrame, ignore: list[str]) -> DataFrame:
    """Files kept, with their pack: the first two path parts, or none for a loose file."""
    parts = F.split("path", "/")
    pack = F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1]))
    return files.filter(~like_any(F.col("path"), ignore)).withColumn("pack", pack)


def pack_sizes(m: DataFrame) -> DataFrame:
    return m.groupBy("pack").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def scene_packs(scenes: DataFrame, per_pack: int = 50) -> DataFrame:
    """Scene -> pack number over the sorted scene names."""
    return global_index(scenes.select("scene").distinct(), ["scene"]).select(
        "scene", F.floor(F.col("rn") / per_pack).cast("int").alias("pack"))


def blob_sha1(content: Column) -> Column:
    """SHA-1 of the content behind a ``blob <size>`` header."""
    body = content.cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(body).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), body))


def changed_files(local: DataFrame, remote: DataFrame, content: str = "text") -> DataFrame:
    """Why each local file must be sent again: new, another size, or another digest. NULL if the same.

    ``remote(path, remote_size, sha256, sha1)``; a file has one of the two digests."""
    j = local.join(remote, "path", "left")
    why = (F.when(F.col("remote_size").isNull() & F.col("sha256").isNull() & F.col("sha1").isNull(), "new")
           .when(F.col("remote_size") != F.col("size"), "size")
           .when(F.col("sha256").isNotNull() & (F.col("sha256") != F.sha2(F.col(content).cast("binary"), 256)), "digest")
           .when(F.col("sha1").isNotNull() & (F.col("sha1") != blob_sha1(F.col(content))), "digest"))
    return j.withColumn("why", why)


def greedy_batches(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Batch number of each file, filled greedily in path order.

    Where a batch starting at a file would end depends only on the files just after it, so
    every file gets its "next start" at once (a range window inside blocks with a halo of one
    batch). The starts really used are those reachable from the first file; they are found
    by doubling jumps, in as many rounds as the number of batches has digits in base two."""
    f = global_index(files.select("path", "size"), ["path"])
    f = _before(f)
    width = max(FAN, max_files)
    h = halo(f, "rn", 0, max_files, width)
    fit = W.partitionBy("blk_").orderBy("before_").rangeBetween(0, max_bytes)
    # the last file whose start lies within the limit: the batch ends just before it
    reach = h.withColumn("to_", F.max("rn").over(fit)).filter("own_")
    nxt = F.least(F.greatest(F.when(F.col("total_") - F.col("before_") <= max_bytes, F.col("files_")).otherwise(F.col("to_")), F.col("rn") + 1),
                  F.col("rn") + max_files)
    jump = cut(reach.select("rn", nxt.alias("next_")))
    starts = cut(jump.filter("rn = 0").select("rn"))
    n = 1
    while True:
        more = starts.join(jump, "rn").select(F.col("next_").alias("rn")).join(jump.select("rn"), "rn", "left_semi")
        grown = cut(starts.union(more).distinct())
        m = grown.count()
        if m == n:
            break
        starts, n = grown, m
        jump = cut(jump.join(jump.select(F.col("rn").alias("next_"), F.col("next_").alias("far_")), "next_", "left")
                   .select("rn", F.coalesce("far_", "next_").alias("next_")))
    marked = f.join(starts.withColumn("s_", F.lit(1)), "rn", "left").withColumn("one_", F.lit(1))
    b = running(marked, ["one_"], "rn", F.coalesce("s_", F.lit(0)), "batch_")
    return b.select("path", "size", (F.col("batch_") - 1).cast("int").alias("batch"))


def _before(f: DataFrame) -> DataFrame:
    """Bytes ahead of each file, all bytes and the number of files."""
    one = f.withColumn("one_", F.lit(1))
    r = running(one, ["one_"], "rn", F.col("size"), "upto_")
    t = f.agg(F.sum("size").alias("total_"), F.count(F.lit(1)).alias("files_"))
    return r.join(F.broadcast(t)).withColumn("before_", F.col("upto_") - F.col("size")).drop("one_", "upto_")


def packs_to_do(packs: DataFrame, remote: DataFrame, repack: list[str]) -> DataFrame:
    """Packs not held remotely, or asked for again by pattern."""
    r = remote.select("pack").distinct().withColumn("held_", F.lit(True))
    return packs.join(r, "pack", "left").filter(F.col("held_").isNull() | like_any(F.col("pack"), repack)).drop("held_")


def packs_to_pull(remote: DataFrame, done: DataFrame, skip: list[str]) -> DataFrame:
    """Remote packs without a done marker, less those skipped by pattern."""
    return remote.filter(~like_any(F.col("pack"), skip)).join(done.select("pack"), "pack", "left_anti")


def seeded_sample(frames: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows picked by a seeded hash of their key: the same rows on every run and cluster."""
    return frames.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary")), key).limit(n)
