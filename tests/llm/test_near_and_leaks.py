"""Operators 8 and 9 against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from churnscope.llm import decontam, setsketch_dedup as near, textvec
from churnscope.llm.common import Scratch

VOCABULARY = [a + b for a in "ka lo mi nu pe ri so tu".split() for b in "ban del fin gor hul jam".split()]


def _text(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def _brute(rows, k, percent):
    sets, by = {}, {}
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * both >= percent * union:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def _family(rng, first, copies, words, edits):
    base = _text(rng, words)
    out = [(first, " ".join(base))]
    for c in range(1, copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        out.append((first + c, " ".join(w)))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(docs, words):
    rng = random.Random(words)
    rows = [(1000 + i, " ".join(_text(rng, rng.randint(1, 80)))) for i in range(60)]
    rows += _family(rng, 0, 40, 120, 12) + _family(rng, 100, 30, 60, 6) + _family(rng, 200, 12, 300, 40)
    rows += [(3000, ""), (3001, None), (3002, "one"), (3003, "ONE\n"), (3004, " \t")]
    rng.shuffle(rows)
    # Blocks of 8 members, so that buckets are split over several tasks.
    p = near.SketchParams(words=words, block=8)
    got = near.near_duplicates(docs(rows), params=p)
    assert sorted(map(tuple, got.collect())) == _brute(rows, words, 80)


def test_near_duplicates_edges(edges, nothing):
    got = near.near_duplicates(edges)
    rows = got.collect()
    assert len(rows) == edges.count() and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    part = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert part == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert near.near_duplicates(nothing).count() == 0
    assert near.drop_near_copies(edges).columns == edges.columns


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r["id"]: r["label"] for r in near.components(Scratch(spark), edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102)}}


@pytest.mark.parametrize("kind", ["shuffled", "descending"])
def test_components_of_chains_in_any_order(spark, kind):
    ids = list(range(3000))
    if kind == "shuffled":
        random.Random(8).shuffle(ids)
    else:
        ids[1:] = ids[:0:-1]  # the least id, then the others from the highest down
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:])) + [(5001, 5000)], "a long, b long")
    got = {r["id"]: r["label"] for r in near.components(Scratch(spark), edges).collect()}
    assert got == {**dict.fromkeys(ids, 0), 5000: 5000, 5001: 5000}


def test_sketches_merge_and_estimate():
    p = near.SketchParams()
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = h[:1000], h[100:1100]  # similarity 900 / 1100
    ra, rb = (near.sketch(x, np.array([0]), p)[0] for x in (a, b))
    assert (np.maximum(ra, rb) == near.sketch(np.union1d(a, b), np.array([0]), p)[0]).all()
    count = lambda m: np.array([m.sum()])
    est = near.likely_similarity(count(ra > rb), count(ra < rb), count(ra == rb), np.array([1000]), np.array([1000]), p.base)
    assert abs(est[0] - 900 / 1100) < 0.08


def test_slope_tells_where_the_peak_is():
    rng = np.random.default_rng(2)
    na, nb = rng.integers(80, 101, 400), rng.integers(80, 101, 400)
    equal = rng.integers(150, 300, 400)
    greater = ((300 - equal) * rng.uniform(0.3, 0.7, 400)).astype(int)
    est = near.likely_similarity(greater, 300 - equal - greater, equal, na, nb, 1.1, grid=2001)
    told = near.reaches(0.7, greater, 300 - equal - greater, equal, na, nb, 1.1)
    clear = abs(est - 0.7) > 0.002
    assert (told == (est >= 0.7))[clear].all() and 20 < told.sum() < 380


def test_compact_sets_never_lose_a_link():
    rng = np.random.default_rng(1)
    for n in (5, 300, 2000):
        h = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        less = h[: max(1, int(n * 0.9))]
        assert near._may_link(near._compact(h), near._compact(less), n, len(less), 80)


def test_word_hashes_follow_the_words():
    texts = [b"a b  a", b"", b"b\ta"]
    h, d = textvec.words(texts)
    assert d.tolist() == [0, 0, 0, 2, 2]
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


def _edits(a: str, text: str) -> int:
    """Least edits of ``a`` against any passage of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def _windows(text, p):
    codes, _ = decontam.normalise(decontam.code_points(text))
    s = bytes(codes).strip(b" ").decode("latin-1")
    if len(s) < p.min_chars:
        return []
    starts = [0] if len(s) <= p.window else [*range(0, len(s) - p.window, p.stride), len(s) - p.window]
    return [s[i : i + p.window] for i in starts]


def test_leaks_equal_brute_force(spark, docs):
    rng = random.Random(3)
    p = decontam.LeakParams()
    items = [(i, " ".join(_text(rng, rng.randint(12, 30)))) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    rows = []
    for i in range(60):
        body = _text(rng, rng.randint(0, 40))
        leak = items[rng.randrange(12)][1]
        kind = i % 5
        if kind == 1:
            body += [leak.upper().replace(" ", "\n ")]
        elif kind == 2:  # a passage of it
            body += [leak[: len(leak) // 2]]
        elif kind >= 3:  # edits
            chars = list(leak)
            for _ in range(rng.randint(1, 14)):
                at = rng.randrange(len(chars))
                chars[at : at + rng.randint(0, 1)] = rng.choice("abcdef")
            body += ["".join(chars)]
        rows.append((i, " ".join(body + _text(rng, 5))))
    rows += [(70, None), (71, ""), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs(rows), benchmark).collect()}
    want = set()
    for d, t in rows:
        codes, _ = decontam.normalise(decontam.code_points(t or ""))
        text = bytes(codes).decode("latin-1")
        for i, s in items:
            for w in _windows(s or "", p):
                if _edits(w, text) <= min(int(len(w) * p.budget), (len(w) - decontam.Q) // decontam.Q):
                    want.add((d, i))
    assert got == want and len(want) > 20
    # Blocks of the benchmark make no difference.
    small = decontam.LeakParams(block_chars=200)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs(rows), benchmark, params=small).collect()} == want
    kept = decontam.drop_leaks(docs(rows), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want if d is not None}


def test_leak_offsets_are_code_points(spark, docs):
    item = "Überall standen die alten Häuser, und niemand wußte mehr, wem sie einst gehört hatten oder wozu sie dienten."
    text = "é\U0001f600 vor " + item + " danach"
    got = decontam.find_leaks(docs([(1, text)]), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert len(got) == 1 and item.rstrip(".") in text[got[0]["start"] : got[0]["end"]]
    assert got[0]["end"] - got[0]["start"] <= len(item) + 4


def test_leaks_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "nothing of this occurs in any of the documents at all, not a bit")], "item_id long, text string")
    assert decontam.find_leaks(edges, none).count() == 0
    assert decontam.find_leaks(edges, one).count() == 0
    assert decontam.find_leaks(nothing, one).count() == 0
    assert decontam.drop_leaks(edges, one).columns == edges.columns
