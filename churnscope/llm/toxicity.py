"""Toxicity scores from a bidirectional GRU over characters and words.

The model (``bigru``) is fitted in numpy on a bounded sample of labelled
documents, then every document of the corpus is cut into overlapping windows
of words, all windows are scored where the document lies, and the highest
decides. Scoring has no shuffle; the model, under a megabyte, travels with the
tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm import bigru, textvec
from churnscope.llm.common import Scratch, drop_texts, lean, text_digest

BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class ToxicityParams:
    """``sample_toxic`` and ``sample_clean`` bound the labelled documents the fit sees (by order of
    their ids' hashes), ``sample_windows`` the windows of each, spread over the whole text."""

    window: int = 40
    stride: int = 28
    sample_toxic: int = 1500
    sample_clean: int = 2500
    sample_windows: int = 12
    threshold: float = 0.7


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampler(p: ToxicityParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = []
            for text in b.column(2).to_pylist():
                words = bigru.words_of(text or "")
                starts = bigru.window_starts(len(words), p.window, p.stride)
                if len(starts) > p.sample_windows:
                    starts = [starts[i] for i in np.linspace(0, len(starts) - 1, p.sample_windows).astype(int)]
                bags.append([" ".join(words[s : s + p.window]) for s in starts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.string()))], names=["id", "toxic", "bag"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", params: ToxicityParams = ToxicityParams()) -> bigru.Model:
    """A model from the labelled documents that are not held out.

    A document with several labels is toxic if one says so; labels without id
    or value are ignored. Without both classes among the labels the model is
    untrained and scores low throughout.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(F.col(label_id_col)))
    known = known.groupBy(F.col(label_id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = scratch.stage(known.join(docs.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi"), "toxicity-labels")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, params.sample_toxic), (0, params.sample_clean))]
    chosen = scratch.stage(parts[0].unionByName(parts[1]), "toxicity-sample")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # At most sample_toxic + sample_clean ids: a bounded broadcast.
    picked = own.join(F.broadcast(chosen), "id").select("id", "toxic", "text").mapInArrow(lean(_sampler(params)), "id long, toxic int, bag array<string>")
    rows = sorted(picked.dropDuplicates(["id"]).collect(), key=lambda r: r["id"])
    label = np.array([r["toxic"] for r in rows], np.float32)
    toxic, clean = int(label.sum()), len(label) - int(label.sum())
    if not toxic or not clean:
        model = bigru.Model(bigru.new_params(1, np.random.default_rng(7)), {}, params.window, params.stride)
        model.scale, model.shift = 0.0, -4.0
        return model
    weight = (n[0] / clean) / (n[1] / toxic)
    scratch.drop([known, chosen])
    return bigru.train([[w.split(" ") if w else [] for w in r["bag"]] for r in rows], label, params.window, params.stride, clean_weight=weight)


def _scorer(model: bigru.Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in textvec.blocks(texts, BLOCK_BYTES):
                scores = model.scores([bigru.words_of(t) for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(scores, pa.float64())], names=[b.schema.names[0], "score"])

    return run


def score(docs: DataFrame, model: bigru.Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: ``id_col``, held_out, score (0 to 1), predicted (score >= threshold).

    The score uses the text alone. Null and empty texts get the score of an
    empty window. Repeated rows give repeated rows, an empty table none; other
    columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(lean(_scorer(model)), "id long, score double")
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; its columns are unchanged.

    The text alone decides, so rows that share an id with a toxic one stay and rows
    without an id go if they are toxic. Null counts as the empty text; repeated rows share
    their decision; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, params=params)
    own = docs.select(text_digest(F.col(text_col)).alias("sha"), F.col(text_col).alias("text"))
    scored = own.mapInArrow(lean(_scorer(model)), "sha string, score double")
    toxic = scored.where(F.col("score") >= params.threshold).select("sha").distinct()
    return drop_texts(docs, scratch.stage(toxic, "toxic-texts"), text_digest(F.col(text_col)))
