"""Two tokenizers side by side: where their tokens end together, and which ids meet there.

Each distinct text is tokenised and aligned once. Rows are grouped by their full text, counts of
id pairs are weighted by how often a text occurs, and the measures of a text are joined back to
its rows by a digest of the text.
"""

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import join_copies, keyed, small, stored

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_ALIGNED = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                      ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())])
#: A space between letters or digits.
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: a printable Latin-1 byte is its own character, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both libraries and the bytes of every id, loaded once a process."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_alphabet()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(map(letters.__getitem__, t)) if letters.keys() >= set(t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: No piece goes on behind a space that follows something else: then texts may be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.len_a, self.len_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        #: id k as decimal text and its end mark: at 2 k within a group, at 2 k + 1 as the group's last.
        self.text_a = [b"%d%c" % (i, c) for i in range(len(entries)) for c in b",|"]
        self.text = self.text_a + [b"%d%c" % (i, c) for i in range(len(pieces)) for c in b",;"]
        self.text_len = np.array(list(map(len, self.text)), np.int64)

        self.known: dict[str, tuple | None] = {}
        self.met: set[int] = set()

    def parts(self, text: str) -> list[str]:
        """``text`` cut at single spaces between letters or digits, which go: both sides end a token there and start the next with the space."""
        return _CUT.split(text) if self.cuts else [text]

    def records(self, texts: list[str], held: int = 150_000) -> list[tuple[int, int, bytes, bytes] | None]:
        """Tokens of both sides, the groups as text and the linked ids as pairs of 32-bit numbers, or None where a side does not give the bytes back.

        A text is its parts put together. Parts of up to 64 characters that come a second time are remembered, up to ``held`` of them."""
        cut = [self.parts(t) for t in texts]
        if len(self.known) > held:
            self.known.clear()
        if len(self.met) > 2 * held:
            self.met.clear()
        new = list({p: None for parts in cut for p in parts if p not in self.known})
        self.known.update(zip(new, self._parts(new)))
        out = []
        for parts in cut:
            rows = list(map(self.known.__getitem__, parts))
            if None in rows:
                out.append(None)
                continue
            n, groups, links = zip(*rows)
            total = sum(n)
            out.append((total & 0xFFFFFFFF, total >> 32, b";".join(groups), b"".join(links)))
        for p in new:
            if len(p) > 64 or (h := hash(p)) not in self.met:
                del self.known[p]
                if len(p) <= 64:
                    self.met.add(h)
        return out

    def _parts(self, parts: list[str]) -> list[tuple[int, bytes, bytes] | None]:
        """``n_a + (n_b << 32)``, groups and links of each part.

        Parts that begin and end with letters or digits go to the libraries as texts of many parts, in which
        both sides end a token at every cut; the others, and texts that are not given back, part by part."""
        out: list[tuple | None] = [None] * len(parts)
        joint = [k for k, p in enumerate(parts) if p[:1].isalnum() and p[-1:].isalnum()] if self.cuts else []
        alone = sorted({*range(len(parts))} - {*joint})
        for runs in ([joint[k:k + 4096] for k in range(0, len(joint), 4096)], [[k] for k in alone]):
            again = []
            for at in range(0, len(runs), 4096):
                again += self._runs(parts, runs[at:at + 4096], out)
            if again:
                self._runs(parts, [[k] for run in again if len(run) > 1 for k in run], out)
        return out

    def _runs(self, parts: list[str], runs: list[list[int]], out: list) -> list[list[int]]:
        """Fill ``out`` for the parts of each run, one text a run; returns the runs that were not given back."""
        texts = [" ".join(parts[k] for k in run) for run in runs]
        all_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        all_b = self.b.encode(texts, num_threads=1)
        good, ids_a, ids_b, again = [], [], [], []
        for run, text, a, b in zip(runs, texts, all_a, all_b):
            if b" " + text.encode() == b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b)):
                good += run
                ids_a += a
                ids_b += b
            else:
                again.append(run)
        if not good:
            return again
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = self.align(a, b)
        # a part is a run of tokens on both sides and a run of groups, up to where its bytes end
        ends = np.cumsum([len(parts[k].encode()) + 1 for k in good])
        upto_a, upto_b = (np.searchsorted(np.cumsum(n[x]), ends) + 1 for n, x in ((self.len_a, a), (self.len_b, b)))
        order = self.grouped(a, b, end_a, end_b)
        shown = b"".join(map(self.text.__getitem__, order.tolist()))
        marks = np.cumsum(self.text_len[order])[upto_a + upto_b - 1]
        links = np.stack([a[end_a], b[end_b]], axis=1).astype("<u4").tobytes()
        pairs = 8 * np.searchsorted(end_a, upto_a)
        sizes = np.diff(upto_a, prepend=0) + (np.diff(upto_b, prepend=0) << 32)
        x = y = 0
        for k, n, mark, pair in zip(good, sizes.tolist(), marks.tolist(), pairs.tolist()):
            out[k] = n, shown[x:mark - 1], links[y:pair]
            x, y = mark, pair
        return again

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``a`` and in ``b`` of the tokens that end at the same byte."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.searchsorted(ends_a, ends_b)
        same = ends_a[np.minimum(at, len(ends_a) - 1)] == ends_b
        return at[same], np.flatnonzero(same)

    def grouped(self, a, b, end_a, end_b) -> np.ndarray:
        """Places in ``text`` of all tokens, group by group, first those of ``a``: ``a1,a2|b1;a3|b2,b3;``."""
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        before = np.concatenate([[0], end_b + 1])
        order = np.empty(len(a) + len(b), np.int64)
        in_a, in_b = np.searchsorted(end_a, at_a), np.searchsorted(end_b, at_b)
        order[at_a + before[in_a]] = 2 * a + (end_a[in_a] == at_a)
        order[at_b + end_a[in_b] + 1] = len(self.text_a) + 2 * b + (end_b[in_b] == at_b)
        return order


@functools.cache
def _loaded(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def _portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text each, one row at least."""
    sizes = np.array([len(t) if t else 0 for t in batch.column(0).to_pylist()])
    into = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(into)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def aligned_texts(texts: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Each of the distinct ``texts`` (text, copies) aligned; ``links`` holds the linked ids as pairs of 32-bit numbers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(a_file, b_file)
        for batch in small(batches):
            for rows in _portions(batch, 1 << 20):
                words, out = rows.column(0).to_pylist(), []
                for text, copies, found in zip(words, rows.column(1).to_pylist(), both.records(words)):
                    n_a, n_b, groups, links = found or (0, 0, b"", b"")
                    shown = hashlib.sha256(groups).hexdigest() if found else ""
                    out.append((hashlib.sha256(text.encode()).digest(), copies, n_a, n_b, len(links) // 8, len(links) // 8, shown, links))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ALIGNED)], schema=_ALIGNED)

    return texts.select("text", "copies").mapInArrow(work, _ddl(_ALIGNED))


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of all rows from their second column, a above b in 64 bits, and how many each row has."""
    links = batch.column(1).to_pylist()
    both = np.frombuffer(b"".join(links), "<u4").reshape(-1, 2).astype(np.int64)
    return both[:, 0] << 32 | both[:, 1], np.array([len(x) // 8 for x in links], np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(aligned: DataFrame, held: int = 500_000) -> DataFrame:
    """``pair, n, best``: links of each id pair over all rows, and whether no pair of its second id has more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, late, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            return _summed(np.concatenate([keys, *[p for p, _ in late]]), np.concatenate([n, *[c for _, c in late]]))

        for batch in small(batches):
            pairs, sizes = _pairs(batch)
            late.append((pairs, np.repeat(batch.column(0).to_numpy(), sizes)))
            size += len(pairs)
            if size > held:
                (keys, n), late, size = merged(), [], 0
                if len(keys) > held:
                    yield from _slices(keys, n)
                    keys, n = keys[:0], n[:0]
        yield from _slices(*merged())

    counts = aligned.select("copies", "links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return stored(counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair_counts")


def _slices(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + 100_000]), pa.array(n[at:at + 100_000])], names=["pair", "n"])


def align(docs: DataFrame, a_file: str, b_file: str, doc_id="doc_id", text="text", head: int = 400_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row.

    ``a_file`` is a byte-level vocabulary of ``tokenizers`` and gets a space before the text, ``b_file`` a
    ``sentencepiece`` model that adds one itself; both are files of all executors. Bytes where tokens of both
    end cut the text into groups, and the two tokens that end there are linked. A pair of ids counts its links
    over all rows; ``n_best`` are the links of a row whose pair is its second id's most frequent, ties included.

    The ``head`` most frequent pairs, a table of 17 bytes a pair, go to every task and carry the hot ones;
    links of others are shuffled as frequencies per text. Texts held by a thousandth of all rows or more, so a
    thousand at most, are broadcast to their rows.

    Null and empty texts, and texts that either side does not give back byte for byte, have zeros and ``''``.
    Repeated rows are counted apart and null ids kept; only id and text are read.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    aligned = stored(aligned_texts(texts, a_file, b_file), "aligned")
    counts = pair_counts(aligned)
    common = counts.orderBy(F.desc("n"), "pair").limit(head).toArrow()
    order = np.argsort(common.column("pair").to_numpy())
    table = [common.column(c).to_numpy()[order] for c in ("pair", "n", "best")]
    known = spark.sparkContext.broadcast(table)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in small(batches):
            pairs, sizes = _pairs(batch)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.searchsorted(keys, pairs)
            hit = np.zeros(len(pairs), bool) if not len(keys) else keys[np.minimum(at, len(keys) - 1)] == pairs
            at = np.where(hit, at, 0)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            sums, bests = (np.diff(np.concatenate([[0], np.cumsum(np.where(hit, x[at], 0))])[upto]) if len(keys) else np.zeros(batch.num_rows, np.int64)
                           for x in (n, best))
            kinds, kind = np.unique(pairs[~hit], return_inverse=True)
            rare, times = np.unique(row[~hit] * max(1, len(kinds)) + kind, return_counts=True)
            at_row, at_kind = np.divmod(rare, max(1, len(kinds)))
            digests = batch.column(0)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([digests, digests.take(pa.array(at_row))]),
                pa.concat_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(kinds[at_kind])]),
                pa.array(np.concatenate([sums, times])), pa.array(np.concatenate([bests, np.zeros(len(times), np.int64)]))],
                names=["digest", "pair", "n", "best"])

    parts = stored(aligned.select("digest", "links").mapInArrow(measure, "digest binary, pair long, n long, best long"), "measures")
    rare = parts.filter("pair is not null").select("digest", "pair", F.col("n").alias("times")).join(counts, "pair")
    rare = rare.select("digest", (F.col("times") * F.col("n")).alias("n"), (F.col("times") * F.col("best").cast("long")).alias("best"))
    sums = parts.filter("pair is null").select("digest", "n", "best").unionByName(rare)
    sums = sums.groupBy("digest").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    measured = stored(aligned.drop("links").join(sums, "digest"), "measured")
    copies = rows.select("key", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    joined = join_copies(copies, measured, [*MEASURES, "groups_sha256"])
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES],
                         F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
