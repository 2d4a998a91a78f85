"""Operators 3 and 7 and the pipeline."""

from __future__ import annotations

import glob
import random
import re
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from churnscope.llm import bigru, mixing, toxicity
from churnscope.plans.staging import shared_root

# ---------------------------------------------------------------- mixing


def _targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {**{s: float(cap * sizes[s]) for s in full}, **share}
        full |= over


def _corpus(seed):
    rng = random.Random(seed)
    rows = []
    for name, n, most in (("b", 120, 40), ("a", 15, 400), ("\U0001f600", 60, 30), ("é", 4, 6), (None, 50, 25), ("z", 3, 1)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(0, most)), name) for i in range(n)]
    rows += [(900 + i, "same words here now", "b") for i in range(150)]  # a hot cell
    return rows + [(2000, None, "a"), (2001, "\n\t ", "a"), (2002, "x", "empty?"), (None, "three words here", "a"), (2003, "", "void")]


def test_mix_meets_its_targets(docs):
    rows = _corpus(1)
    p = mixing.MixParams(bucket_rows=16)
    got = mixing.mix(docs(rows), params=p).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    want, taken = _targets(total), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), (s, t, taken[s])


def test_mix_reruns_agree(docs):
    rows = _corpus(2)
    first = mixing.mix(docs(rows)).collect()
    again = mixing.mix(docs(rows[::-1]).repartition(5)).collect()
    assert sorted(first, key=str) == sorted(again, key=str)


def test_rates_are_exponential_in_the_size(docs):
    rows = [(i, "w " * (5 + 5 * (i % 4)), "a") for i in range(400)] + [(1000 + i, "w " * 10, "b") for i in range(40)]
    got = mixing.mix(docs(rows)).collect()
    by = defaultdict(list)
    for r in got:
        if r["doc_id"] < 1000:
            by[r["size"]].append(r["copies"])
    mean = [np.log(np.mean(by[s])) for s in (5, 10, 15, 20)]
    assert np.allclose(np.diff(mean), np.diff(mean).mean(), atol=0.06)


def test_mix_edges(edges, nothing):
    assert mixing.mix(edges).count() == edges.count()
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed(edges).columns == [*edges.columns, "mix_copies", "mix_taken"]


# ---------------------------------------------------------------- toxicity


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in bigru.new_params(4, rng, chars=3, words=2, char_hidden=3, word_hidden=2, attention=2).items()}
    windows, label = [["ab", "c", "abc"], ["c"], []], np.array([1.0, 0.0, 1.0])
    words = {"ab": 1, "c": 2}
    _, g = bigru.loss_and_grads(p, words, windows, label)
    for k, x in p.items():
        flat = list(np.ndindex(x.shape)) if x.size < 40 else [(97, 0), (98, 2), (99, 1)] if k == "chars" else [tuple(rng.integers(0, x.shape)) for _ in range(8)]
        for at in flat:
            old, e = p[k][at], 1e-5
            up, down = ({**p, k: x.copy()} for _ in range(2))
            up[k][at], down[k][at] = old + e, old - e
            slope = (bigru.loss_and_grads(up, words, windows, label)[0] - bigru.loss_and_grads(down, words, windows, label)[0]) / (2 * e)
            assert abs(slope - g[k][at]) < 1e-6 + 1e-4 * abs(slope), (k, at)


def test_windows_cover_every_word():
    for n in (0, 1, 39, 40, 41, 68, 500):
        starts = bigru.window_starts(n, 40, 28)
        assert sorted({i for s in starts for i in range(s, min(n, s + 40))}) == list(range(n))
    assert bigru.words_of("A" * 50) == ["a" * 24, "a" * 24, "aa"]


def _toxic_corpus(n=900):
    rng = random.Random(4)
    plain = [a + b for a in "ka lo mi nu pe ri so tu".split() for b in "ban del fin gor hul jam kel".split()]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        bad = i % 3 == 0
        if bad:  # a known word, or a known stem with a new ending
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zwog", "xyrr"]) if rng.random() < 0.5 else "qvex" + "".join(rng.choice("aeioubdg") for _ in range(3)))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, docs):
    rows, labels = _toxic_corpus()
    table = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(rows), table)
    extra = [(5000, None), (5001, ""), (None, "kaban"), (5002, "kaban " * 20_000)]
    got = toxicity.score(docs(rows + extra), model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in labels}
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7)
    out = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in truth and r["held_out"]]
    hits = [p for y, p in out if y]
    assert np.mean(hits) > 0.9 and np.mean([p for y, p in out if not y]) < 0.03
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (5000, 5001, 5002))


def test_toxicity_never_reads_held_out_labels(spark, docs):
    rows, labels = _toxic_corpus(120)
    held = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    make = lambda x: toxicity.fit(docs(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int"))
    a, b = make(labels), make(held)
    assert all((a.params[k] == b.params[k]).all() for k in a.params) and (a.scale, a.shift) == (b.scale, b.shift)


def test_toxicity_without_labels(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(edges, none)
    assert toxicity.score(edges, model).where("predicted = 1").count() == 0
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.drop_toxic(edges, none).columns == edges.columns


# ---------------------------------------------------------------- pipeline


def test_pipeline_keeps_and_drops(spark, tmp_path):
    rows, labels = _toxic_corpus(300)
    clean = {i for i, _, y in labels if not y}
    leak = " ".join(random.Random(8).choices([a + b for a in "ka lo mi nu".split() for b in "ban del fin gor".split()], k=20))
    base = rows[1][1] + " " + rows[2][1] + " " + rows[4][1]
    near = base.split()
    near[len(near) // 2] = "changed"
    rows += [(400, base), (401, base.replace(" ", "\n")), (402, " ".join(near)), (403, f"kaban {leak} kadel"), (404, None), (405, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "source_mixing"]
    kept, frame = [{i for i, _ in rows}], docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "source_mixing":
            assert frame.columns == docs.columns
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in frame.select("doc_id").collect()})
    toxic, exact, nears, leaks, mixed = kept[1:]
    assert len(kept[0] - toxic - clean) > 80 and len(clean - toxic) <= 4
    assert 400 in exact and 401 not in exact and len({404, 405} & exact) == 1
    assert 400 in nears and 402 not in nears and exact - nears == {402}
    assert nears - leaks == {403}
    assert mixed <= leaks and len(mixed) > len(leaks) / 2
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in run.collect()} == mixed


def test_pipeline_bounds_its_state_stores(spark, docs):
    """The stream of the second stage runs with its settings: commits add changes to the checkpoint, not whole stores."""
    root = f"{shared_root(spark)}/churnscope-llm".removeprefix("file:")
    before = set(glob.glob(f"{root}/dedup-state-*"))
    stage = dict(corpus_pipeline.STAGES)["exact_dedup"]
    assert stage(spark, docs([(1, "a b"), (2, "a  b"), (3, "c")]), "").count() == 2
    (state,) = set(glob.glob(f"{root}/dedup-state-*")) - before
    assert glob.glob(f"{state}/state/**/*.changelog", recursive=True)
    assert not glob.glob(f"{state}/state/**/*.zip", recursive=True)
