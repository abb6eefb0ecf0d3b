"""Log-probabilities of texts under a smoothed n-gram model, read as a weighted backoff automaton.

Counts come from every training text: all words, pairs and triples. Pairs and triples that occur twice
or more are arcs; what discounting takes from a state goes to its failure arc. A text is one left-to-right
traversal: an arc adds its log-probability, a failure arc adds its weight and leads to the next shorter
context. The arcs of most use are an automaton of bounded size in every task, where texts are traversed
with the weights of the whole model. What any other arc adds to a text that goes along it, and what words
outside the frequent ones do, is joined afterwards, so that bounds have no part in a score.
"""

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import Hashes, keyed, small, stored, utf8

#: The token after the last word of a text; as a context it also stands before the first.
END = b""
#: Bits of a frequent word's rank; grams of such words are their ranks side by side, with this on triples.
BITS = 18
TRIPLE = 1 << 60
_MASK = (1 << BITS) - 1
_APART = 1 << 62
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORDS = pa.schema([("token", pa.binary()), ("n", pa.int64())])
_GRAMS = pa.schema([("triple", pa.bool_()), ("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64())])
_ARC = pa.schema([("triple", pa.bool_()), ("code", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64())])
_SEEN = pa.schema([("key", pa.int64()), ("code", pa.int64())])
_PARTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("token", pa.binary()), ("n", pa.int64()), ("n_known", pa.int64()),
                    ("base", pa.float64()), ("score", pa.float64())])
_PART_SCHEMA = "key long, doc_id long, token binary, n long, n_known long, base double, score double"


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case; ``END`` is added by those who count."""
    return text.lower().split()


def word_counts(rows: DataFrame, held: int = 250_000) -> DataFrame:
    """``token, n`` over the whole column ``text``, ends included, summed in the task first."""
    def slices(seen: Counter) -> Iterator[pa.RecordBatch]:
        items = iter(seen.items())
        while part := list(itertools.islice(items, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v for _, v in part], pa.int64())], schema=_WORDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small(batches):
            for text in utf8(batch.column(0)):
                seen.update(tokens(text))
                seen[END] += 1
                if len(seen) > held:
                    yield from slices(seen)
                    seen.clear()
        yield from slices(seen)

    return rows.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Numbers(Hashes):
    """word -> its rank among the frequent words, else a negative hash of 63 bits."""

    def __init__(self, ids: dict[bytes, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        n = self.ids.get(word)
        n = self[word] = (xxhash.xxh3_64_intdigest(word) >> 1) - (1 << 63) if n is None else n
        return n


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A negative hash of two numbers, of 63 bits."""
    h = left.astype(np.uint64) * _M1
    h = ((h ^ (h >> np.uint64(32))) + right.astype(np.uint64)) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return ((h ^ (h >> np.uint64(32))) | np.uint64(1 << 63)).astype(np.int64)


def _pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a >= 0) & (b >= 0), a << BITS | b & _MASK, _joined(a, b))


def _triple_codes(ab: np.ndarray, bc: np.ndarray) -> np.ndarray:
    return np.where((ab >= 0) & (bc >= 0), TRIPLE | ab << BITS | bc & _MASK, _joined(ab, bc))


def _grams(texts: list[bytes], numbers: Numbers, held: int) -> Iterator[tuple]:
    """For slices of the texts, pairs and triples: ``triple, code, left, right, number of the text``.

    Left and right are the words of a pair and the pairs of a triple.
    """
    flat, size = [], []
    for text in texts:
        words = tokens(text)
        # texts are kept apart by a token that no gram may hold
        flat += [_APART, 0, *map(numbers.__getitem__, words), 0]
        size.append(len(words) + 3)
    flat, text = np.array(flat, np.int64), np.repeat(np.arange(len(size)), size)
    for at in range(0, len(flat), held):
        piece = slice(max(0, at - 2), at + held)
        x, where = flat[piece], text[piece]
        a, b = x[:-1], x[1:]
        ok = (a != _APART) & (b != _APART)
        pair = _pair_codes(a, b)
        three = ok[:-1] & ok[1:]
        ok[:max(0, min(at, 2) - 1)] = False
        yield False, pair[ok], a[ok], b[ok], where[:-1][ok]
        left, right = pair[:-1][three], pair[1:][three]
        yield True, _triple_codes(left, right), left, right, where[:-2][three]


def gram_counts(rows: DataFrame, head: Broadcast, held: int = 2_000_000) -> DataFrame:
    """``triple, l, r, n`` of all pairs and triples.

    Grams of frequent words have their code as ``l`` and 0 as ``r``; others have what they are made of.
    """
    def flush(kept: list[tuple]) -> Iterator[pa.RecordBatch]:
        for triple in (False, True):
            code, left, right = (np.concatenate([k[i] for k in kept if k[0] == triple]) for i in (1, 2, 3))
            code, first, n = np.unique(code, return_index=True, return_counts=True)
            plain = code >= 0
            left, right = np.where(plain, code & ~TRIPLE, left[first]), np.where(plain, 0, right[first])
            for at in range(0, len(code), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n[s]), triple)), *[pa.array(c[s]) for c in (left, right, n)]], schema=_GRAMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, kept, size = Numbers(head.value[0]), [], 0
        for batch in small(batches):
            for some in _grams(utf8(batch.column(0)), numbers, held):
                kept.append(some)
                size += len(some[1])
                if size > held and some[0]:
                    yield from flush(kept)
                    kept, size = [], 0
        if kept:
            yield from flush(kept)

    return rows.select("text").mapInArrow(count, "triple boolean, l long, r long, n long").groupBy("triple", "l", "r").agg(F.sum("n").alias("n"))


def repeated(grams: DataFrame) -> DataFrame:
    """``triple, code, l, r, n`` of the grams that occur twice or more; ``l, r`` are a pair's words and a triple's pairs.

    Without a code, ``n`` is how many others a task saw.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = [0, 0]
        for batch in batches:
            triple, left, right, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for t in (False, True):
                alone[t] += int(((n == 1) & (triple == t)).sum())
            triple, left, right, n = (c[n > 1] for c in (triple, left, right, n))
            plain = (left >= 0) & (right == 0)
            left, right = (np.where(plain, left >> BITS, left),
                           np.where(plain, left & np.where(triple, (1 << 2 * BITS) - 1, _MASK), right))
            code = np.where(triple, _triple_codes(left, right), _pair_codes(left, right))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (triple, code, left, right, n)], schema=_ARC)
        yield pa.RecordBatch.from_pylist([{"triple": t, "n": alone[t]} for t in (False, True)], schema=_ARC)

    return grams.select("triple", "l", "r", "n").mapInArrow(run, "triple boolean, code long, l long, r long, n long")


@dataclass
class Automaton:
    """State 0 is the root. ``arcs[state * width + word]`` is the number of an arc."""

    width: int
    arcs: dict[int, int]
    weight: list[float]
    target: list[int]
    fail: list[int]
    fail_weight: list[float]
    start: int

    def score(self, words: list[int]) -> float:
        """Sum of log10 probabilities, but for the root's of words below 0, which are not known here."""
        arcs, weight, target, fail, fail_weight, width = self.arcs, self.weight, self.target, self.fail, self.fail_weight, self.width
        s, total = self.start, 0.0
        for w in words:
            if w < 0:
                while s:
                    total += fail_weight[s]
                    s = fail[s]
                continue
            i = arcs.get(s * width + w)
            while i is None:
                total += fail_weight[s]
                s = fail[s]
                i = arcs.get(s * width + w)
            total += weight[i]
            s = target[i]
        return total


@dataclass
class Model:
    """Arrays of bounded size, enough to build the automaton in every process."""

    total: int
    distinct: int
    counts: np.ndarray          # of the frequent words, by rank; word 0 is END
    pair_code: np.ndarray
    pair_n: np.ndarray
    triple_code: np.ndarray
    triple_n: np.ndarray
    discounts: tuple[float, float]
    #: Failure weights of the frequent words and of the pairs here in the model of all arcs, nan for
    #: those without arcs; without them this is a model of its own.
    back1: np.ndarray | None = None
    back2: np.ndarray | None = None

    def root(self) -> np.ndarray:
        return (self.counts + 1) / (self.total + self.distinct + 1)

    def automaton(self) -> Automaton:
        """States are the root, words with arcs and pairs with arcs; every state's probabilities sum to 1."""
        p0, d2, d3 = self.root(), *self.discounts
        width = len(self.counts)
        a, b = np.divmod(self.pair_code, 1 << BITS)
        p1 = (self.pair_n - d2) / self.counts[a]
        left1 = 1 - np.bincount(a, p1, width)
        lower1 = 1 - np.bincount(a, p0[b], width)
        back1 = np.maximum(left1, 1e-12) / np.maximum(lower1, 1e-12)
        # probability of c after b, through b's arc or its failure
        ab, c = np.divmod(self.triple_code - TRIPLE, 1 << BITS)
        tb = ab & _MASK
        at = np.searchsorted(self.pair_code, ab)
        below = np.searchsorted(self.pair_code, tb << BITS | c)
        found = below < len(self.pair_code)
        found[found] = self.pair_code[below[found]] == (tb << BITS | c)[found]
        p2 = (self.triple_n - d3) / self.pair_n[at]
        short = back1[tb] * p0[c]
        short[found] = p1[below[found]]
        left2 = 1 - np.bincount(at, p2, len(a))
        lower2 = 1 - np.bincount(at, short, len(a))
        back2 = np.maximum(left2, 1e-12) / np.maximum(lower2, 1e-12)

        has1, has2 = np.zeros(width, bool), np.zeros(len(a), bool)
        has1[a] = True
        has2[at] = True
        if self.back1 is not None:
            back1, back2 = self.back1, self.back2
            has1, has2 = ~np.isnan(back1), ~np.isnan(back2)
        state1 = np.where(has1, np.cumsum(has1), 0)                      # of a word, 0 without arcs
        state2 = np.where(has2, has1.sum() + np.cumsum(has2), state1[b])  # of a pair, else of its last word
        keys = [np.arange(width), state1[a] * width + b, state2[at] * width + c]
        targets = [state1, state2, np.where(found, 0, state1[c])]
        targets[2][found] = state2[below[found]]
        weights = np.log10(np.concatenate([p0, p1, p2]))
        return Automaton(width, dict(zip(np.concatenate(keys).tolist(), range(len(weights)))), weights.tolist(), np.concatenate(targets).tolist(),
                         [0, *[0] * int(has1.sum()), *state1[b[has2]].tolist()],
                         [0.0, *np.log10(back1[has1]).tolist(), *np.log10(back2[has2]).tolist()], int(state1[0]))


def _cutoff(levels: list[tuple[int, int]], most: int) -> int:
    """Least count of 2 or more above which no more than ``most`` grams stand; levels are (count, grams)."""
    cut, kept = max((n for n, _ in levels), default=1) + 1, 0
    for n, grams in sorted(levels, reverse=True):
        if n < 2 or kept + grams > most:
            break
        cut, kept = n, kept + grams
    return cut


def learn(rows: DataFrame, counts: DataFrame, pairs: int = 30_000, triples: int = 8_000, arcs: int = 400_000,
          head: int = 200_000, head_bytes: int = 64) -> tuple[Model, Broadcast]:
    """The bounded part of the model of the training rows' ``text`` and the broadcast ``({word: rank}, [count by rank])``."""
    return _learn(rows, counts, pairs, triples, arcs, head, head_bytes)[:2]


def _learn(rows: DataFrame, counts: DataFrame, pairs: int = 30_000, triples: int = 8_000, arcs: int = 400_000,
           head: int = 200_000, head_bytes: int = 64) -> tuple[Model, Broadcast, DataFrame]:
    """Also all arcs, ``held`` if the bounded part has them.

    ``counts`` is the stored ``word_counts(rows)``. Parameters bound what is broadcast: ``head``
    frequent words of at most ``head_bytes`` bytes, ``arcs`` pairs of the first ``pairs`` words and as
    many triples of the first ``triples``. Every training text is counted.
    """
    spark = rows.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter(F.octet_length("token") == 0).select("n").first()
    top = (counts.filter((F.octet_length("token") > 0) & (F.octet_length("token") <= head_bytes))
           .orderBy(F.desc("n"), "token").limit(min(head, _MASK)).toArrow())
    number = np.array([ends.n if ends else 0, *top.column("n").to_pylist()], np.int64)
    known = spark.sparkContext.broadcast(({t: i for i, t in enumerate(top.column("token").to_pylist(), 1)}, number))
    grams = stored(repeated(gram_counts(rows, known)), "arcs")
    alone = {r.triple: r.n for r in grams.filter("code IS NULL").groupBy("triple").agg(F.sum("n").alias("n")).collect()}
    arc = grams.filter("code IS NOT NULL")
    most = F.greatest(*[F.shiftright("code", BITS * i).bitwiseAND(_MASK) for i in range(3)])
    near = (F.col("code") >= 0) & (most < F.when(F.col("triple"), min(pairs, triples)).otherwise(pairs))
    levels = arc.groupBy("triple", near.alias("near"), F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("grams")).collect()
    of = {t: [(r.n, r.grams) for r in levels if r.triple == t and r.near] for t in (False, True)}
    cut2, cut3 = _cutoff(of[False], arcs), _cutoff(of[True], arcs)
    cut3 = max(cut2, cut3)  # the pairs of a triple here are then here too
    discount = []
    for t in (False, True):
        n1, n2 = max(1, alone.get(t, 0)), sum(r.grams for r in levels if r.triple == t and r.n == 2)
        discount.append(n1 / (n1 + 2 * n2) if n2 else 0.5)
    held = near & (F.col("n") >= F.when(F.col("triple"), cut3).otherwise(cut2))
    kept = arc.filter(held).select("triple", "code", "n").toArrow().sort_by("code")
    three = kept.column("triple").to_numpy()
    code, n = kept.column("code").to_numpy(), kept.column("n").to_numpy()
    return Model(total, distinct, number, code[~three], n[~three], code[three], n[three], tuple(discount)), known, arc.withColumn("held", held)


def _numbered(counts: DataFrame, known: Broadcast) -> DataFrame:
    """``token, x, c``: the words with their numbers."""
    schema = pa.schema([("token", pa.binary()), ("x", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(known.value[0])
        for batch in small(batches, 10_000):
            x = [numbers[t] if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.int64()), batch.column(1)], schema=schema)

    return counts.select("token", "n").mapInArrow(run, "token binary, x long, c long")


def complete(model: Model, known: Broadcast, arcs: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gives ``model`` the failure weights of the whole model, from all arcs.

    Returns ``code, gain``: what an arc beyond the bounded part adds to a text that goes along it, which is its
    log-probability less what the traversal without it pays, and the failure weight of the context it leads
    to; and ``token, c, back`` of all words, with their own failure weights.
    """
    d2, d3 = model.discounts
    words = stored(_numbered(counts, known), "numbers")
    size = float(model.total + model.distinct + 1)
    pair = arcs.filter(~F.col("triple")).join(words.select(F.col("x").alias("l"), F.col("c").alias("cl")), "l")
    pair = pair.join(words.select(F.col("x").alias("r"), F.col("c").alias("cr")), "r")
    pair = stored(pair.select("code", "l", "n", "held", ((F.col("n") - d2) / F.col("cl")).alias("p"), ((F.col("cr") + 1) / size).alias("lower")), "pairs")
    triple = arcs.filter("triple").join(pair.select(F.col("code").alias("l"), F.col("n").alias("m")), "l")
    triple = triple.join(pair.select(F.col("code").alias("r"), F.col("p").alias("lower")), "r")
    triple = stored(triple.select("code", "l", "held", ((F.col("n") - d3) / F.col("m")).alias("p"), "lower"), "triples")

    def backs(of: DataFrame) -> DataFrame:
        left = [F.greatest(1 - F.sum(c), F.lit(1e-12)) for c in ("p", "lower")]
        return stored(of.groupBy("l").agg((left[0] / left[1]).alias("back")), "backs")

    back1, back2 = backs(pair), backs(triple)
    mine = back1.filter("l >= 0").toArrow()
    model.back1 = np.full(len(model.counts), np.nan)
    model.back1[mine.column("l").to_numpy()] = mine.column("back").to_numpy()
    mine = back2.join(pair.filter("held").select(F.col("code").alias("l")), "l").toArrow()
    model.back2 = np.full(len(model.pair_code), np.nan)
    model.back2[np.searchsorted(model.pair_code, mine.column("l").to_numpy())] = mine.column("back").to_numpy()
    gain = F.log10("p") - F.log10("lower") - F.log10("back")
    onward = F.coalesce(F.log10("onward"), F.lit(0.0))
    pair = pair.filter("not held").join(back1, "l").join(back2.select(F.col("l").alias("code"), F.col("back").alias("onward")), "code", "left")
    gains = pair.select("code", (gain + onward).alias("gain")).unionByName(triple.filter("not held").join(back2, "l").select("code", gain.alias("gain")))
    words = words.join(back1.withColumnRenamed("l", "x"), "x", "left").select("token", "c", F.log10("back").alias("back"))
    return gains, words


def _elsewhere(rows: DataFrame, known: Broadcast, shared: Broadcast, held: int = 2_000_000) -> DataFrame:
    """``key, code`` of every pair and triple in the texts that the bounded part lacks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(known.value[0])
        here = {False: np.append(shared.value.pair_code, _APART), True: np.append(shared.value.triple_code, _APART)}
        for batch in small(batches):
            keys = batch.column(0).to_numpy()
            for triple, code, _, _, text in _grams(utf8(batch.column(2)), numbers, held):
                off = here[triple][np.searchsorted(here[triple], code)] != code
                code, key = code[off], keys[text[off]]
                for at in range(0, len(code), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at:at + 100_000]), pa.array(code[at:at + 100_000])], schema=_SEEN)

    return rows.mapInArrow(run, "key long, code long")  # of the same columns as the traversal, so keys are the same


_BUILT: list = [None, None]


def _automaton(model: Model) -> Automaton:
    """Built once a process for a model."""
    if _BUILT[0] is not model:
        _BUILT[:] = model, model.automaton()
    return _BUILT[1]


def score(docs: DataFrame, train: Column, doc_id="doc_id", text="text", **sizes) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``train`` says, from ``doc_id`` (a long), which rows the model learns from. A null text is
    empty and has one token, its end. Repeated rows and null ids are kept apart. Without training
    rows every token has the root's probability, 1 over V + 1 = 1.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    counts = stored(word_counts(rows.filter(train)), "words")
    model, known, arcs = _learn(rows.filter(train), counts, **sizes)
    gains, numbers = complete(model, known, arcs, counts)
    shared = spark.sparkContext.broadcast(model)
    floor = float(np.log10(1 / (model.total + model.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number = known.value
        automaton = _automaton(shared.value)
        root = np.log10(shared.value.root())
        for batch in small(batches):
            out: list[tuple] = []
            for key, doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                words = tokens(body)
                found = [ids.get(w, -1) for w in words] + [0]
                at = np.array(found, np.int64)
                rest = Counter(w for w, i in zip(words, found) if i < 0)
                at = at[at >= 0]
                out.append((key, doc, None, len(found), int((number[at] > 0).sum()), float(root[at].sum()), automaton.score(found)))
                out += [(key, None, w, n, None, None, None) for w, n in rest.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS)] if out else
                                             [pa.array([], f.type) for f in _PARTS], schema=_PARTS)

    parts = stored(rows.mapInArrow(run, _PART_SCHEMA), "scores")
    c, back = F.coalesce(F.col("c"), F.lit(0)), F.coalesce(F.col("back"), F.lit(0.0))
    rare = (parts.filter("token is not null").select("key", "token", "n").join(numbers, "token", "left")
            .groupBy("key").agg(F.sum(F.col("n") * (F.log10(c + 1) + floor)).alias("rare"), F.sum(F.col("n") * back).alias("back"),
                                F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known")))
    beyond = _elsewhere(rows, known, shared).join(gains, "code").groupBy("key").agg(F.sum("gain").alias("gain"))
    add, more = F.coalesce("rare", F.lit(0.0)), F.coalesce("back", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
    return parts.filter("token is null").join(rare, "key", "left").join(beyond, "key", "left").select(
        "doc_id", train.alias("train"), F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("score") + add + more).alias("score"))
