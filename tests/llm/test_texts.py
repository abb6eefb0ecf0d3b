"""Operators on documents beside plain versions, over every awkward case."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from voxmill.llm import language, leaks, lines, mixing, pairs, search, shared, substrings, tokens, toxicity
from voxmill.llm.catalog import tokenizer_file

ROWS = cases.made()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.frame(spark, [])


def rows_of(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)


# language model -----------------------------------------------------------------------------------

def test_base_scores_and_counts(docs):
    train = shared.remainder("doc_id", 7) != 2
    got = rows_of(language.score(docs, train, pairs=20, triples=10, arcs=50, head=12), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score")
    c = Counter()
    for i, t, _ in ROWS:
        if cases.crc(i) % 7 != 2:
            c.update([*cases.lowered(t), b""])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in ROWS:
        w = [*cases.lowered(t), b""]
        want.append((i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    for a, b in zip(got, sorted(want, key=str)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_every_state_sums_to_one_and_traversal_is_backoff(spark, docs):
    rows = shared.keyed(docs)
    counts = language.word_counts(rows).cache()
    model, known = language.learn(rows, counts, pairs=45, triples=45, arcs=400, head=100)
    assert model.distinct == len(model.counts)          # all words are frequent here, so sums can be taken
    a = model.automaton()
    unseen = 1 / (model.total + model.distinct + 1)
    for s in range(len(a.fail)):
        total = 0.0
        for w in range(a.width):
            x, q = 0.0, s
            while q * a.width + w not in a.arcs:
                x, q = x + a.fail_weight[q], a.fail[q]
            total += 10 ** (x + a.weight[a.arcs[q * a.width + w]])
        x, q = 0.0, s
        while q:
            x, q = x + a.fail_weight[q], a.fail[q]
        assert total + 10 ** x * unseen == pytest.approx(1)
    assert len(model.pair_code) > 20 and len(model.triple_code) > 0


def test_model_beats_words_alone_on_held_out_copies(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(i, text + f"w{i}", "s") for i in range(40)]
    got = language.score(cases.frame(spark, rows), shared.remainder("doc_id", 7) != 2).collect()
    assert all(r.score > r.base_score for r in got) and {r.train for r in got} == {True, False}


def plain_scores(rows, trained):
    """The same model in plain dictionaries: every pair and triple that comes twice is an arc."""
    grams = [Counter(), Counter(), Counter()]
    for i, t, _ in rows:
        x = [b"", *cases.lowered(t), b""]
        if trained(i):
            grams[0].update(x[1:])
            grams[1].update(zip(x, x[1:]))
            grams[2].update(zip(x, x[1:], x[2:]))
    c, size = grams[0], sum(grams[0].values()) + len(grams[0]) + 1
    discount = []
    for g in grams[1:]:
        n1, n2 = (sum(n == k for n in g.values()) for k in (1, 2))
        discount.append(max(1, n1) / (max(1, n1) + 2 * n2) if n2 else 0.5)
    p0 = lambda w: (c[w] + 1) / size
    p1 = {g: (n - discount[0]) / c[g[0]] for g, n in grams[1].items() if n > 1}
    p2 = {g: (n - discount[1]) / grams[1][g[:2]] for g, n in grams[2].items() if n > 1}
    left1, left2 = {}, {}
    for left, p, lower in ((left1, p1, lambda g: p0(g[1])), (left2, p2, lambda g: p1[g[1:]])):
        for g, q in p.items():
            a, b = left.get(g[:-1], (1, 1))
            left[g[:-1]] = a - q, b - lower(g)
    back = {k: max(a, 1e-12) / max(b, 1e-12) for k, (a, b) in (left1 | left2).items()}
    second = lambda g: p1.get(g) or back.get(g[:1], 1) * p0(g[1])
    third = lambda g: p2.get(g) or back.get(g[:2], 1) * second(g[1:])
    for i, t, _ in rows:
        x = [b"", *cases.lowered(t), b""]
        yield i, sum(map(math.log10, [second(tuple(x[:2])), *map(third, zip(x, x[1:], x[2:]))]))


@pytest.mark.parametrize("sizes", [{}, {"pairs": 20, "triples": 10, "arcs": 15, "head": 12}, {"pairs": 1, "triples": 1, "arcs": 0, "head": 1},
                                   {"arcs": 40, "head": 60}])
def test_bounds_have_no_part_in_scores(spark, docs, sizes):
    text = "one two three four five six seven eight nine ten eleven"
    more = [(5000 + i, f"{text} {'zz' * (i % 5)} rare{i // 2} {text.replace('e', 'ee')} a{i % 3} b c", "s") for i in range(30)]
    rows = [r for r in ROWS if r[0] is not None] + more
    got = language.score(cases.frame(spark, rows), shared.remainder("doc_id", 7) != 2, **sizes)
    want = sorted(plain_scores(rows, lambda i: cases.crc(i) % 7 != 2), key=str)
    for a, b in zip(sorted(((r.doc_id, r.score) for r in got.collect()), key=str), want, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_no_training_rows(spark, none):
    assert language.score(none, shared.remainder("doc_id", 7) != 2).count() == 0
    r = language.score(cases.frame(spark, [(1, "a b", "s")]), shared.remainder("doc_id", 7) > 9).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0)


# token counts -------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_tokens_are_the_librarys(spark, docs, none, name):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file(name))
    odd = [(300, "<|endoftext|> a<|endoftext|>b <|startoftext|", "s"), (301, "I'll don't 12345 é   x y\u0085z " + "q" * 9000, "s"),
           (302, "ÀÉ İ ΑΣ ́x ﬁ 漢字かな !!! ...", "s"), (303, "word " * 3000, "s")]
    all_rows = ROWS + odd
    got = rows_of(tokens.token_counts(cases.frame(spark, all_rows), tokenizer_file(name), head=30), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for i, x, _ in all_rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)
    assert tokens.token_counts(none, tokenizer_file(name)).count() == 0


# substring dedup ----------------------------------------------------------------------------------

@pytest.mark.parametrize("window,crowd", [(20, 1 << 24), (20, 0), (7, 2000)])
def test_repeats(spark, docs, window, crowd):
    got = rows_of(substrings.drop_repeats(docs, window, crowd_bytes=crowd), "doc_id", "n_words", "n_removed", "kept")
    kept = cases.repeats(ROWS, window)
    want = []
    for i, t, _ in ROWS:
        w, k = cases.split(t), kept[i, t or ""]
        want.append((i, len(w), len(w) - len(k), " ".join(k)))
    assert got == sorted(want, key=str)
    assert sum(r[2] for r in got) > 500


def test_repeats_in_many_rows_without_id(spark):
    import random
    rng = random.Random(8)
    rows = [(None, " ".join(f"n{rng.randrange(9)}" for _ in range(rng.randrange(5, 60))), "s") for _ in range(1500)]
    rows += [(None, rows[3][1], "s")] * 40 + [(7, rows[4][1] + " more", "s")]
    texts = sorted({t for _, t, _ in rows[:-1]})
    got = substrings.drop_repeats(cases.frame(spark, rows), 6).collect()
    # rows without id come first, in an order of their own: what is left holds each window once
    windows = {tuple(w[p:p + 6]) for t in texts for w in [t.split()] for p in range(len(w) - 5)}
    assert len(got) == len(rows) and sum(r.n_words for r in got) == sum(len(t.split()) for _, t, _ in rows)
    covered = Counter(tuple(w[p:p + 6]) for t in texts for w in [t.split()] for p in range(len(w) - 5))
    clean = {t for t in texts if all(covered[tuple(t.split()[p:p + 6])] == 1 for p in range(len(t.split()) - 5))}
    kept = Counter(r.kept for r in got)
    assert all(kept[t] >= 1 for t in clean) and max(covered.values()) > 1 and len(clean) > 100 and len(windows) > 1000
    assert [r.kept for r in got if r.doc_id == 7] == ["more"] and kept[rows[3][1]] in (0, 41)


def test_words_with_low_bytes_are_no_other_words(spark):
    base = [f"b{i}" for i in range(19)]
    rows = [(i, " ".join([*base, w]), "s") for i, w in enumerate(["end", "end\x01x", "end", "en"])] + [(9, " ".join([*base, "end", "after"]), "s")]
    got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.drop_repeats(cases.frame(spark, rows)).collect()}
    assert {i: n for i, (n, _) in got.items()} == {0: 0, 1: 0, 2: 20, 3: 0, 9: 20} and got[9][1] == "after"


def test_common_words():
    assert substrings.common_words(b"a b c ", b"a b c ") == 3 and substrings.common_words(b"a b c ", b"a b cd ") == 2
    assert substrings.common_words(b"a ", b"b ") == 0 and substrings.common_words(b"a b ", b"a b c ") == 2
    assert sorted(map(sorted, substrings.inner_nodes([(b"a b c ", 0), (b"a b d ", 1), (b"a c ", 2), (b"a b c ", 3)], 2))) == [[0, 1, 3], [2]]


def test_repeats_of_nothing(none):
    assert substrings.drop_repeats(none).count() == 0


# Jaccard join -------------------------------------------------------------------------------------

def near_rows(seed=3):
    import random
    rng = random.Random(seed)
    rows = list(ROWS)
    for g in range(25):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([8, 30, 120, 700]))]
        for k in range(rng.choice([2, 3, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, len(w) // 40])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            rows.append((1000 + 20 * g + k, " ".join(w).upper() if k % 2 else "  ".join(w), "s"))
    return rows


@pytest.mark.parametrize("tile", [512, 3])
def test_groups_and_links(spark, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    rows = near_rows()
    got = rows_of(pairs.jaccard_groups(cases.frame(spark, rows)), "doc_id", "class_id", "n_links", "group_id")
    assert got == cases.jaccard(rows)
    assert sum(r[2] for r in got) > 50


def test_crowded_buckets_split_and_lose_nothing(spark):
    rows = [r for r in near_rows() if r[0] is not None]
    members = pairs._classes(shared.keyed(cases.frame(spark, rows)), 5)
    sets = shared.stored(members.filter("tokens is not null").groupBy("c1").agg(F.min("tokens").alias("tokens")), "sets")
    edges = pairs.candidates(sets, crowd=2, depth=3)
    assert edges.filter("a = b").count() == 0
    linked = {frozenset(e) for e in edges.select("a", "b").collect()}
    assert len(linked) > 20


def test_pairs_split_to_the_last_level_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for p in range(1500):
        a = rng.integers(0, 1 << 32, 128, dtype=np.uint32)
        b = a.copy()
        b[rng.permutation(128)[:25]] = rng.integers(0, 1 << 32, 25, dtype=np.uint32)
        rows += [(2 * p, a.tobytes()), (2 * p + 1, b.tobytes())]
    sets = shared.stored(spark.createDataFrame(rows, "c1 long, tokens binary"), "sets")
    # every node of two sets is split, down to depth 4
    found = {frozenset(e) for e in pairs.candidates(sets, crowd=1, depth=4).select("a", "b").collect()}
    assert found == {frozenset((2 * p, 2 * p + 1)) for p in range(1500)}


def test_keep_one_of_each_group(spark, none):
    rows = near_rows()
    df = cases.frame(spark, rows)
    kept = pairs.keep_one(df)
    assert kept.columns == df.columns
    want = {r[3] for r in cases.jaccard(rows) if r[3] is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert pairs.keep_one(none).count() == 0 and pairs.jaccard_groups(none).count() == 0


def test_a_crowd_of_near_copies_is_not_split_again(spark):
    """Sets that a leader is sure of have met all that is near them, so they stand in one level of each run."""
    rng = np.random.default_rng(5)
    common, made = [f"w{i}" for i in range(400)], []
    for i in range(600):
        words = list(common)
        words[int(rng.integers(400))] = f"x{i}"
        made.append((i, " ".join(words), "s"))
    apart = [(1000 + i, " ".join(f"y{i}_{j}" for j in range(60)), "s") for i in range(50)]
    sets = pairs._classes(shared.keyed(cases.frame(spark, made + apart)), 5).select("c1", "tokens").cache()
    asked, split = [], pairs._split

    def counted(rows, least):
        asked.append(rows.count())
        return split(rows, least)

    pairs._split = counted
    try:
        edges = pairs.candidates(sets, crowd=64).collect()
    finally:
        pairs._split = split
    assert sum(asked) < 1.1 * 650 * pairs._runs(2, 5e-5)
    near = {r.c1 for r in pairs._classes(shared.keyed(cases.frame(spark, made)), 5).collect()}
    reached, todo, beside = set(), [min(near)], {}
    for e in edges:
        beside.setdefault(e.a, []).append(e.b)
        beside.setdefault(e.b, []).append(e.a)
    while todo:
        c = todo.pop()
        if c not in reached:
            reached.add(c)
            todo += beside.get(c, [])
    assert reached == near


# decontamination ----------------------------------------------------------------------------------

def plain_leaks(rows, items, least=0.8):
    parsed = [(t, cases.lowered(x)) for t, x in items]
    parsed = [(t, w) for t, w in parsed if w]
    bags = [Counter(tuple(w[p:p + min(5, len(w))]) for p in range(max(1, len(w) - 4))) for _, w in parsed]
    df = Counter(g for b in bags for g in b)
    weight = lambda g: 1 + math.log(len(parsed) / df.get(g, 1))
    out = []
    for i, x, _ in rows:
        d = cases.lowered(x)
        for (t, w), bag in zip(parsed, bags):
            k, m = min(5, len(w)), min(len(w), len(d))
            best = None
            for s in range(len(d) - m + 1):
                c = Counter(tuple(d[p:p + k]) for p in range(s, s + m - k + 1))
                if not any(g in bag for g in c):
                    continue
                names = set(c) | set(bag)
                v = sum(min(c[g], bag[g]) * weight(g) for g in names) / sum(max(c[g], bag[g]) * weight(g) for g in names)
                if v >= least and (best is None or v > best[0] + 1e-12):
                    best = v, s
            if best:
                out.append((i, t, round(best[0], 9), best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [2000, 2])
def test_leaks(spark, none, most):
    import random
    rng = random.Random(5)
    fresh = lambda n: [f"q{rng.randrange(3000)}" for _ in range(n)]
    texts = [fresh(n) for n in (15, 30, 59, 30)] + [["only", "three", "words"]]
    items = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(5, None), (6, ""), (7, " ".join(texts[0]))]
    rows = list(ROWS[:20]) + ROWS[-6:]
    for i, w in enumerate(texts * 3):
        w = list(w)
        for _ in range(i // 5):
            w[rng.randrange(len(w))] = "changed"
        rows.append((500 + i, " ".join(fresh(i % 4 * 9) + w + fresh(i % 3 * 30)).title(), "s"))
    rows.append((600, " ".join(texts[1][:27]), "s"))
    df, bench = cases.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in leaks.contaminated(df, bench, most=most).collect()), key=str)
    assert got == plain_leaks(rows, items) and len(got) >= 8
    clean = leaks.clean(df, bench, most=most)
    bad = {r[0] for r in got}
    assert clean.columns == df.columns and clean.count() == sum(r[0] not in bad for r in rows)
    assert leaks.contaminated(none, bench).count() == 0 and leaks.contaminated(df, bench.limit(0)).count() == 0 and leaks.clean(df, bench.limit(0)).count() == len(rows)


def test_registered_decontamination_finds_a_planted_passage(spark, tmp_path):
    from voxmill.llm.catalog import QUERIES
    import random
    rng = random.Random(31)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    items = [(k, text(60)) for k in range(20)]
    rows = [(i, text(200) + (f" {items[i % 20][1]} " if i % 9 == 0 else " ") + text(50), "s") for i in range(90)]
    cases.frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 20) for i in range(0, 90, 9)}


def test_index_holds_all_within_the_radius():
    assert leaks.RADIUS < leaks.BITS // leaks.BLOCK * (leaks.NEAR + 1)
    rng = np.random.default_rng(1)
    words = [f"i{x}".encode() for x in rng.integers(0, 999, 40)]
    h = shared.Hashes()
    bag = leaks.shingles(np.array([h[w] for w in words], np.uint64), 5)
    items = leaks.prepare([(0, 5, 40, bag)], 5, 1, {int(g): 1 for g in bag})
    for _ in range(200):
        flip = np.zeros(leaks.BITS, np.uint8)
        flip[rng.choice(leaks.BITS, leaks.RADIUS, replace=False)] = 1
        key = leaks._keys(np.array([40]), items.prints[:1] ^ np.packbits(flip)[None])
        assert np.isin(key, items.keys).any()


# search -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("terms,least", [(None, 2), (3, 2), (None, 1)])
def test_top_k_is_exact(spark, none, terms, least):
    df = cases.frame(spark, ROWS)
    got = sorted(((r.query_id, r["rank"], r.doc_id, round(r.score, 7)) for r in search.search(df, F.col("doc_id") % 5 == 0, k=4, terms=terms, least=least).collect()))
    parsed = [(cases.order(i), k, i, Counter(cases.lowered(t))) for k, (i, t, _) in enumerate(ROWS)]
    n, average = len(parsed), sum(sum(c.values()) for *_, c in parsed) / len(parsed)
    df_of = Counter(w for *_, c in parsed for w in c)
    idf = {w: math.log(1 + (n - x + 0.5) / (x + 0.5)) for w, x in df_of.items() if x >= least}
    want = []
    for _, _, i, q in parsed:
        if i is None or i % 5:
            continue
        ask = sorted((w for w in q if w in idf), key=lambda w: (-q[w] * idf[w], w))[:terms]
        hits = []
        for o, k, j, c in parsed:
            s = sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) for w in ask if w in c)
            if s > 0:
                hits.append((-round(s, 9), o, k, j))
        want += [(i, r, j, round(-s, 7)) for r, (s, _, _, j) in enumerate(sorted(hits)[:4], 1)]
    assert got == sorted(want)
    assert search.search(none, F.col("doc_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("light", [0, 8])
def test_many_shards_give_the_same(spark, monkeypatch, light):
    monkeypatch.setattr(search, "LIGHT", light)
    df = cases.frame(spark, ROWS)
    one = sorted(tuple(r) for r in search.search(df, F.col("doc_id") % 3 == 0).collect())
    real = search.index_shards
    monkeypatch.setattr(search, "index_shards", lambda rows, average: real(rows, average, most_docs=5))
    assert sorted(tuple(r) for r in search.search(df, F.col("doc_id") % 3 == 0).collect()) == one


def test_registered_search_asks_with_whole_texts(spark, tmp_path):
    from voxmill.llm.catalog import QUERIES
    words = lambda i: [f"d{i}w{k}" for k in range(20)]
    rows = [(20, " ".join(words(20)), "s"), (40, " ".join([*["loud"] * 9, *words(40), "faint"]), "s"), (41, "faint", "s")]
    rows += [(50 + i, " ".join(["loud"] * 3 + words(60 + i)), "s") for i in range(15)]
    cases.frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.query_id, r["rank"]): r for r in QUERIES["op9_top_k_search"](spark, str(tmp_path)).collect()}
    # words of one row only count
    assert got[20, 1].doc_id == 20 and got[40, 1].doc_id == 40
    n, average = len(rows), sum(len(t.split()) for _, t, _ in rows) / len(rows)
    assert got[20, 1].score == pytest.approx(20 * math.log(1 + (n - 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 20 / average)))


# toxicity -----------------------------------------------------------------------------------------

def test_machine_learns_words_and_meetings(spark):
    import random
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 30, 200]))]
        kind = i % 6
        w += {0: ["vile"], 1: ["mild", "group"], 2: ["mild"], 3: ["group"]}.get(kind, [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(kind in (0, 1))))
    df, lab = cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit(toxicity.sample(df, lab, shared.remainder("doc_id", 3) != 1, 500, 500), least=6.0, epochs=300)
    got = {r.doc_id: r.score for r in toxicity.score(df, machine).collect()}
    held = [i for i in got if cases.crc(i) % 3 == 1]
    assert sum((got[i] >= 0.5) == bool(labels[i][2]) for i in held) > 0.97 * len(held)
    kept = toxicity.accepted(df, machine, 0.5)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i] < 0.5}


def test_score_is_the_sum_over_all_pairs(spark):
    """Bias, weights and one product of factors for each pair of a text's features, by the plain formula."""
    names = ["vile", "group", "mild", "other", "noun"]
    features = np.array(sorted({h for t in names for h in toxicity.hashed(t)}), np.uint32)
    rng = np.random.default_rng(6)
    m = toxicity.Machine(features, -0.3, rng.normal(0, 1, len(features)), rng.normal(0, 1, (len(features), 4)))
    rows = [(i, " ".join(names[k] for k in rng.integers(0, 5, i % 7)), "s") for i in range(40)] + [(90, None, "s"), (91, "vile " * 500, "s")]
    got = {r.doc_id: r.score for r in toxicity.score(cases.frame(spark, rows), m).collect()}
    for i, t, _ in rows:
        have = sorted({int(np.searchsorted(features, h)) for x in toxicity.terms(t) for h in toxicity.hashed(x) if h in set(features.tolist())})
        z = m.bias + sum(m.w[a] for a in have) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(have) for b in have[:k])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))), rel=1e-9)
    assert len(set(got.values())) > 10


def test_scores_of_awkward_rows(spark, docs, none):
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (41, 1, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(toxicity.sample(docs, lab, shared.remainder("doc_id", 3) != 1, 10, 10))
    got = toxicity.score(docs, machine).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, machine).count() == 0 and toxicity.accepted(none, machine).count() == 0
    empty = toxicity.fit(toxicity.sample(docs, lab.limit(0), shared.remainder("doc_id", 3) != 1, 10, 10))
    assert all(0 < r.score < 0.5 for r in toxicity.score(docs, empty).collect())


# line dedup ---------------------------------------------------------------------------------------

def plain_lines(rows, support=10, depth=3, constant=0.6, spread=None):
    import re
    from collections import defaultdict
    found = []
    for i, t in {(i, t or "") for i, t, _ in rows}:
        at = []
        for line in t.split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*", "<*>", line))
            at.append((len(w), tuple(w[:depth]), tuple(w)))
        for p, (n, lead, w) in enumerate(at):
            around = (at[p - 1][:2] if p else None, at[p + 1][:2] if p + 1 < len(at) else None)
            if n:
                found.append((i, t, p, (n, lead), w, around))
    times = Counter(rows and [(i, t or "") for i, t, _ in rows])
    leaf = Counter()
    place = Counter()
    for i, t, _, l, w, _ in found:
        leaf[l] += times[i, t]
        for q, x in enumerate(w):
            place[l, q, x] += times[i, t]
    shapes = defaultdict(list)
    for i, t, p, l, w, around in found:
        if leaf[l] >= support:
            known = [place[l, q, x] >= support for q, x in enumerate(w)]
            if sum(known) >= constant * len(w) - 1e-12:
                shapes[l, tuple(x if k else "<*>" for x, k in zip(w, known))].append((i, t, p, t if spread is None else around))
    gone = defaultdict(set)
    for rows_at in shapes.values():
        n = len({r[3] for r in rows_at})
        if n >= support and n >= (spread or 0) * sum(times[r[0], r[1]] for r in rows_at):
            for i, t, p, _ in rows_at:
                gone[i, t].add(p)
    return gone


def test_templates_of_few_texts_between_many_neighbours(spark):
    """A template of two texts that stands between ever different lines recurs, as one of ten texts does."""
    other = ["alpha one", "beta two three", "gamma", "delta four five six", "epsilon seven", "zeta", "eta eight nine", "theta ten", "iota", "kappa eleven twelve", "lambda", "mu x"]
    rows = [(d, "\n".join(x for i, o in enumerate(other) for x in (f"{o} {chr(97 + d)}", f"disk usage is {i} percent")), 1) for d in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    assert [r.n_dropped for r in lines.drop_recurring(df, between=0.5).orderBy("doc_id").collect()] == [12, 12]
    assert [r.n_dropped for r in lines.drop_recurring(df).collect()] == [0, 0]
    ten = spark.createDataFrame([(d, f"start\ndisk usage is {d} percent\nend", 1) for d in range(10)], "doc_id long, text string, n_chars int")
    assert all(r.n_dropped == 3 for r in lines.drop_recurring(ten, between=0.5).collect())


@pytest.mark.parametrize("spread", [0.5, None])
def test_templates(spark, none, spread):
    import random
    rng = random.Random(9)
    rows = list(ROWS)
    for i in range(60):
        own = [" ".join(f"u{rng.randrange(9999)}x" for _ in range(rng.randrange(3, 12))).replace("u", "uu").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(4)]
        own.insert(rng.randrange(5), f"Posted by user {rng.choice('KLMNOPQRSTUV') * 3} on 2024-{i:02d} in news today")
        if i % 2:
            own.insert(0, "All rights reserved.")
        rows.append((1000 + i, "\n".join(own), "s"))
    copy = "same copied text here\nand its second line\nand a third of it"
    rows += [(2000 + i, copy, "s") for i in range(30)]
    df = cases.frame(spark, rows)
    got = lines.drop_recurring(df, spread=spread).collect()
    gone = plain_lines(rows, spread=spread)
    want = []
    for i, t, _ in rows:
        ls = (t or "").split("\n")
        g = gone.get((i, t or ""), set())
        want.append((i, t if t is None or not g else "\n".join(x for p, x in enumerate(ls) if p not in g), len(ls), len(g)))
    assert sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    assert all("Posted by" not in by[1000 + i].kept_text and "All rights" not in by[1000 + i].kept_text and by[1000 + i].n_dropped == 1 + i % 2 for i in range(60))
    assert all(by[2000 + i].kept_text == copy for i in range(30))
    clash = ["kept_text", "n_lines", "n_dropped", "row", "kept", "lines", "line_nos", "k1", "k2", "__k1", "__gone"]
    named = df.select("doc_id", "text", "n_chars", *[F.lit("own").alias(c) for c in clash])
    clean = lines.cleaned(named, spread=spread)
    assert clean.columns == named.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in clean.collect()), key=str) == sorted(
        ((i, t, None if t is None else len(t)) for i, t, _, _ in want), key=str)
    assert clean.filter(" OR ".join(f"`{c}` <> 'own'" for c in clash)).count() == 0
    assert lines.drop_recurring(none.drop("kept_text")).count() == 0


def test_templates_recur_by_text_whatever_stands_around(spark):
    word = lambda i, k: "".join("abcdefghij"[int(d)] for d in f"{i:03d}{k}")
    own = lambda i, k: " ".join(word(i, k) + s for s in ("x", "y", "z", "u"))
    block = ["Share this page with friends", "Sign up for our newsletter today", "Terms of use apply here"]
    rows = [(i, "\n".join([own(i, 0), "", "Read more on our site", "", own(i, 1)]), "s") for i in range(12)]     # between blank lines
    rows += [(100 + i, "\n".join([own(100 + i, 0), *block, own(100 + i, 1)]), "s") for i in range(12)]           # inside a block
    hot = "Follow us on every network\n" + own(300, 0)
    rows += [(200 + i, own(200 + i, 0) + "\nFollow us on every network", "s") for i in range(12)] + [(400 + i, hot, "s") for i in range(40)]
    by = {r.doc_id: r for r in lines.drop_recurring(cases.frame(spark, rows).drop("kept_text"), spread=None).collect()}
    assert all(by[i].kept_text == "\n".join([own(i, 0), "", "", own(i, 1)]) for i in range(12))
    assert all(by[100 + i].kept_text == "\n".join([own(100 + i, 0), own(100 + i, 1)]) for i in range(12))
    assert all(by[200 + i].kept_text == own(200 + i, 0) for i in range(12))
    assert all(by[400 + i].kept_text == own(300, 0) for i in range(40))


# mixing -------------------------------------------------------------------------------------------

def test_exponent_meets_entropy_and_repeats():
    t = [9000, 500, 500, 10, 0]
    a = mixing.exponent(t, 10010, 0.8, 1000)
    w = mixing.weights(t, a)
    assert 0 < a < 1 and w.sum() == pytest.approx(1) and w[-1] == 0
    assert mixing.entropy(w) >= 0.8 * math.log(4) - 1e-6 > mixing.entropy(mixing.weights(t, a + 1 / mixing.GRID)) - 1e-6
    b = mixing.exponent(t, 10010, 0.99, 2)
    assert all(10010 * x <= 2 * n + 1e-3 for x, n in zip(mixing.weights(t, b), t))
    assert any(10010 * x > 2 * n for x, n in zip(mixing.weights(t, b - 1 / mixing.GRID), t))
    assert mixing.exponent([], 5, 0.9, 4) == 1 and mixing.exponent([5, 5], 10, 0.9, 4) == 1


def test_budgets_are_met_in_blocks(spark, none):
    rows = [(i, "w " * (i % 7 + 1), f"s{0 if i % 10 else i % 3 + 1}") for i in range(600)] + ROWS[-9:]
    got = mixing.mix(cases.frame(spark, rows), share=0.97, repeats=5, block_tokens=100).collect()
    size = Counter()
    for i, t, s in rows:
        size[s or ""] += len(cases.split(t))
    names = sorted(size)
    t = [size[s] for s in names]
    w = mixing.weights(t, mixing.exponent(t, sum(t), 0.97, 5))
    drawn, per = Counter(), Counter()
    for r in got:
        drawn[r.source] += r.n_tokens
        per[r.source, r.epoch, r.doc_id] += 1
    for s, x in zip(names, w):
        assert 0 <= math.floor(sum(t) * x + 0.5) - drawn[s] < 60        # less than the next text
    # every epoch but a source's last is whole
    last = {s: max((r.epoch for r in got if r.source == s), default=0) for s in names}
    count = Counter((s or "", i) for i, _, s in rows)
    for s, e in last.items():
        for x in range(e):
            assert {i: n for (a, b, i), n in per.items() if (a, b) == (s, x)} == {i: n for (a, i), n in count.items() if a == s}
    assert max(last.values()) > 0 and mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(cases.frame(spark, rows), most_sources=2)
