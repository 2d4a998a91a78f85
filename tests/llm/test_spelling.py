"""Operator 11 against every pair of words, and its edges."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from churnscope.llm import spelling
from churnscope.llm.queries import QUERIES


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(rows, every=None, shortest=7, least=2, factor=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if every:
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if h % every == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def _rows(seed, docs=60):
    rng = random.Random(seed)
    letters = "abcdeéß×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(12)]
    base += ["a" * 7, "a" * 8, "a" * 9, "abababab", "babababa"]
    out = []
    for i in range(docs):
        words = []
        for _ in range(150):
            w = rng.choice(base[: rng.choice([3, len(base)])])
            for _ in range(rng.choice([0] * 12 + [1, 2])):
                p, c = rng.randrange(len(w)), rng.choice(letters)
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :], w + c])
            words.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        out.append((i, rng.choice([" ", ", ", "\n", "7", "Š"]).join(words)))
    return out


def test_variants_equal_all_pairs(docs):
    for seed, every in ((1, None), (2, 31), (3, 5)):
        rows = _rows(seed)
        got = spelling.spelling_variants(docs(rows), every=every)
        assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
        assert sorted(map(tuple, got.collect()), key=str) == _brute(rows, every)


def test_chains_of_forms_lead_to_the_last(docs):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]
    rows = [(i, " ".join([w] * (2 * 10**i))) for i, w in enumerate(chain)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_variants(docs(rows)).collect()}
    assert got == {a: (b, chain[-1]) for a, b in zip(chain, chain[1:])} | {chain[-1]: (None, chain[-1])}


def test_shorter_words_and_other_factors(docs):
    rows = [(1, "abcd abcd abcd abce abce bcd abcde abcde"), (2, "ABCD " * 9)]
    assert sorted(map(tuple, spelling.spelling_variants(docs(rows), shortest=4, factor=4).collect()), key=str) == _brute(rows, shortest=4, factor=4)


def test_edges(docs, edges, nothing):
    rows = [(None, "sometimes Sometimes someTimes"), (None, "sometimes"), (1, None), (1, ""), (2, "letters" * 40_000), (2, "letters" * 40_000), (3, "sometymes " * 50)]
    assert sorted(map(tuple, spelling.spelling_variants(docs(rows), every=31).collect()), key=str) == _brute(rows, 31)
    assert spelling.spelling_variants(nothing).collect() == []
    assert spelling.spelling_variants(edges).collect() == []


def test_query_equals_all_pairs(spark, tmp_path, docs):
    rows = _rows(4, 40)
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows, 31)
