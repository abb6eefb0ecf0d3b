"""Token counts without ids: pieces once per distinct pre-token, then sums over documents.

A pre-token is a run of non-space bytes. The tokenizer never merges across white space, so the
pieces of a text are those of its runs, special strings in a run included, and the library itself
counts each distinct run once.
"""

import functools
import itertools
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import keyed, small, stored, utf8

_FREQUENT = pa.schema([("token", pa.binary()), ("n", pa.int64())])
_PIECES = pa.schema([("token", pa.binary()), ("n", pa.int64()), ("pieces", pa.int64())])
_COUNTED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("token", pa.binary()), ("n", pa.int64()),
                      ("n_bytes", pa.int64())])


def pretoken_counts(rows: DataFrame, held: int = 250_000) -> DataFrame:
    """``token, n``: distinct pre-tokens of ``text`` and how often they occur, summed in the task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small(batches):
            for text in utf8(batch.column(0)):
                seen.update(text.split())
                if len(seen) > held:
                    yield from _slices(seen)
                    seen.clear()
        yield from _slices(seen)

    return rows.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _slices(seen: Counter) -> Iterator[pa.RecordBatch]:
    items = iter(seen.items())
    while part := list(itertools.islice(items, 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v for _, v in part], pa.int64())], schema=_FREQUENT)


@functools.cache
def _tokenizer(file: str):
    """Loaded once a process; a task counts on its own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(file)


def piece_counts(counts: DataFrame, tokenizer: str) -> DataFrame:
    """``token, n, pieces``: the library's count for each distinct pre-token. ``tokenizer`` is a file of all executors."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).encode_batch_fast
        for part in small(batches, 1024):
            texts = [t.decode() for t in part.column(0).to_pylist()]
            found = [len(e) for e in encode(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), part.column(1), pa.array(found, pa.int64())], schema=_PIECES)

    return counts.mapInArrow(pieces, "token binary, n long, pieces long")


def token_counts(docs: DataFrame, tokenizer: str, doc_id="doc_id", text="text", limit: int = 2048,
                 head: int = 100_000, head_bytes: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, begin, end and added tokens left out.

    The ``head`` most frequent pre-tokens of at most ``head_bytes`` bytes, a table of proven size,
    go to every task and carry the hot keys; the rest are shuffled as frequencies per row and joined.
    A null text is empty with 0 tokens, repeated rows are counted apart, null ids are kept.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = stored(piece_counts(pretoken_counts(rows), tokenizer), "pieces")
    common = pieces.filter(F.octet_length("token") <= head_bytes).orderBy(F.desc("n"), "token").limit(head).select("token", "pieces")
    common = common.toArrow()
    known = spark.sparkContext.broadcast(dict(zip(common.column("token").to_pylist(), common.column("pieces").to_pylist())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in small(batches):
            out: list[tuple] = []
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                words = text.split()
                found = list(map(table.get, words))
                out.append((key, doc, None, sum(filter(None, found)), len(text)))
                if None in found:
                    rest = Counter(w for w, n in zip(words, found) if n is None)
                    out += [(key, None, w, n, None) for w, n in rest.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _COUNTED)] if out else
                                             [pa.array([], f.type) for f in _COUNTED], schema=_COUNTED)

    parts = stored(rows.mapInArrow(count, "key long, doc_id long, token binary, n long, n_bytes long"), "frequencies")
    rest = parts.filter("token is not null").join(pieces.select("token", "pieces"), "token").select("key", (F.col("n") * F.col("pieces")).alias("n"))
    rest = rest.groupBy("key").agg(F.sum("n").alias("rest"))
    total = F.col("n") + F.coalesce("rest", F.lit(0))
    return (parts.filter("token is null").join(rest, "key", "left")
            .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))
