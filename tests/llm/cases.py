"""Small tables with every awkward case, and plain versions of the operators."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n_words long, kept_text string"


def made(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts over few words, copies, near copies, repeated rows, nulls, empties and a long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "A", "x1", "été", "ß,"]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 18, 19, 20, 21, 40, 90]))]
        rows.append((i, "\n".join([" ".join(w[:len(w) // 2]), " ".join(w[len(w) // 2:])]), f"s{i % 3}"))
    long = " ".join(rng.choice(words) for _ in range(6000))
    rows += [(200, long, "s0"), (201, long[:20000] + " tail", "s1"), (202, rows[8][1], "s2"), (203, rows[9][1] + " more", "s2")]
    rows += [(204, "a " * 60, "s0"), (205, "a\tb\x0bc\rd " * 12, "s0"), (206, None, None), (207, "", "s1"), (208, " \n ", "s1")]
    rows += [rows[5], rows[5], (None, "null id " * 8, "s1"), (None, "null id " * 8, "s1"), (None, None, None)]
    return rows


def frame(spark, rows):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, 7, "clash") for i, t, s in rows], SCHEMA)


def split(text) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def lowered(text) -> list[bytes]:
    return (text or "").encode().lower().split()


def crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def order(doc_id):
    return -math.inf if doc_id is None else doc_id


def repeats(rows, window: int) -> dict:
    """(id, text) -> kept words; equal rows are one document, other rows of one id must not share windows here."""
    docs = sorted({(i, t or "") for i, t, _ in rows}, key=lambda r: (order(r[0]), r[1]))
    seen, out = set(), {}
    for i, t in docs:
        w = split(t)
        gone = set()
        for p in range(len(w) - window + 1):
            s = tuple(w[p:p + window])
            if s in seen:
                gone.update(range(p, p + window))
            seen.add(s)
        out[i, t] = [x for p, x in enumerate(w) if p not in gone]
    return out


def shingles(words, n=5):
    return frozenset(tuple(words[p:p + n]) for p in range(max(1, len(words) - n + 1))) if words else frozenset()


def jaccard(rows, least=0.8) -> list[tuple]:
    """Sorted (id, class, links, group) of every row."""
    classes = defaultdict(list)
    for i, t, _ in rows:
        classes[tuple(lowered(t))].append(i)
    sets = [(shingles(w), min((i for i in ids if i is not None), default=None)) for w, ids in classes.items()]
    root, links = list(range(len(sets))), Counter()

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][0] & sets[b][0])
            if both and both >= least * len(sets[a][0] | sets[b][0]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    group = {}
    for k, (_, i) in enumerate(sets):
        g = find(k)
        group[g] = min((x for x in (group.get(g), i) if x is not None), default=None)
    out = []
    for k, ids in enumerate(classes.values()):
        out += [(i, sets[k][1], links[k], group[find(k)]) for i in ids]
    return sorted(out, key=str)


def sha(words) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
