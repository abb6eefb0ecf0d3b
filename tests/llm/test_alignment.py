"""Alignment of two tokenizers beside a plain one, token by token."""

import hashlib
from collections import Counter

import pytest

from tests.llm import cases
from voxmill.llm import alignment
from voxmill.llm.catalog import tokenizer_file

FILES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
SPECIAL = [(900, "a<|endoftext|>b <s> </s> <unk> x", "s"), (901, "▁lower one eighth ▁", "s"), (902, " a  b   c\n\n\td", "s"), (903, "日本語 текст 🙂🙂 é é", "s"),
           (904, " ", "s"), (905, "\0x", "s"), (906, "ﬁ ½ ①", "s")]


def plain(rows):
    both = alignment.Tokenizers(*FILES)
    letters = alignment.byte_alphabet()

    def tokens(text):
        want = (" " + text).encode()
        a = both.a.encode(" " + text, add_special_tokens=False).ids
        raw = [bytes(letters[c] for c in both.a.id_to_token(i)) for i in a]
        b = both.b.encode(text)
        pieces = [both.b.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if both.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        return (list(zip(a, raw)), list(zip(b, raw_b))) if text and b"".join(raw) == want == b"".join(raw_b) else ([], [])

    def links(a, b):
        ends, at = {}, 0
        for i, raw in a:
            at += len(raw)
            ends[at] = i
        at, out = 0, []
        for i, raw in b:
            at += len(raw)
            if at in ends:
                out.append((ends[at], i))
        return out

    def groups(a, b):
        out, x, y, at_x, at_y = [], [], [], 0, 0
        a, b = list(a), list(b)
        while a or b:
            if b and (not a or at_x > at_y or at_x == at_y and x):
                i, raw = b.pop(0)
                y.append(str(i))
                at_y += len(raw)
            else:
                i, raw = a.pop(0)
                x.append(str(i))
                at_x += len(raw)
            if at_x == at_y and x and y:
                out.append(",".join(x) + "|" + ",".join(y))
                x, y = [], []
        return out

    known = {t: tokens(t or "") for _, t, _ in rows}
    count = Counter(p for _, t, _ in rows for p in links(*known[t]))
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for i, t, _ in rows:
        a, b = known[t]
        found, cut = links(a, b), groups(a, b)
        out.append((i, len(a), len(b), len(cut), len(found), sum(count[p] == top[p[1]] for p in found), sum(count[p] for p in found),
                    hashlib.sha256(";".join(cut).encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("head", [400_000, 20, 0])
def test_against_plain(spark, head):
    rows = cases.made() + SPECIAL + [(1000 + i, "the hot text, twice", "s") for i in range(300)]
    got = alignment.align(cases.frame(spark, rows), *FILES, head=head)
    assert got.columns == ["doc_id", *alignment.MEASURES, "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_empty_table(spark):
    assert alignment.align(cases.frame(spark, []), *FILES).collect() == []
    assert [tuple(r)[1:] for r in alignment.align(cases.frame(spark, [(1, None, "s"), (1, "", "s")]), *FILES).collect()] == [(0,) * 6 + ("",)] * 2


def test_parts_have_the_tokens_of_the_whole_text():
    both = alignment.Tokenizers(*FILES)
    assert both.cuts
    texts = [" ".join(t or "" for _, t, _ in cases.made() + SPECIAL[2:4]), "x" * 5000, "a b " * 2000, " lead  and   trail  ", "it's 5 o'clock, don't 1 2 x_ y ½ z"]
    whole = alignment.Tokenizers(*FILES)
    whole.cuts = False
    for held in (150_000, 3, 3, 3):
        for text, got, want in zip(texts, both.records(texts, held), whole.records(texts)):
            assert got == want and got[0] == len(both.a.encode(" " + text, add_special_tokens=False).ids)
    assert all(len(p) <= 64 for p in both.known)
