"""Benchmark decontamination by q-gram counting and banded alignment.

Benchmark items are cut into overlapping windows of normalised characters. A
window matches a document where some passage lies within its edit budget. By
the q-gram lemma a window of n characters and a passage at most k edits away
share at least n - q + 1 - k*q q-grams, on diagonals that differ by at most k;
so shared q-grams are counted in overlapping diagonal bands 2(k+1) wide, every
band that meets the bound is retained, and alignment restricted to the band's
diagonals decides. Nothing else is compared, and no true match is missed.

Documents are read once, whole, where they lie: the step has no shuffle. The
benchmark goes to the tasks in blocks of at most ``block_chars`` characters; a
larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm import textvec
from churnscope.llm.common import Scratch, drop_texts, lean, text_digest

Q = 8
#: Codes of a normalised text: 32 between words, 1 between documents.
GAP, END = 32, 1
BLOCK_CHARS = 1 << 19


@dataclass(frozen=True)
class LeakParams:
    """``window`` characters, cut every ``stride``; ``budget`` edits per character.

    Items of fewer than ``min_chars`` normalised characters are too short to
    tell a leak from chance and match nothing.
    """

    window: int = 80
    stride: int = 40
    budget: float = 0.0875
    min_chars: int = 32
    block_chars: int = 4 << 20


def _word_table() -> np.ndarray:
    """Code of each character below 0x250; 0 where it separates words."""
    t = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        if chr(c).isalnum():
            low = chr(c).lower()
            t[c] = ord(low) if len(low) == 1 and ord(low) < 256 else 128 + c % 128
    return t


WORD_CODES = _word_table()


def normalise(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one byte a character) and their positions in ``codes`` (code points).

    Letters and digits are lower-cased; each run of other characters becomes
    one gap. Characters past Latin fold onto 128 codes, which can only bring
    texts closer, and separators of the general punctuation and CJK blocks are
    gaps. Code point END stays as it is.
    """
    table = WORD_CODES
    out = np.where(codes < 0x250, table[np.minimum(codes, 0x24F)], (128 + codes % 128).astype(np.uint8))
    out[((codes >= 0x2000) & (codes < 0x2070)) | ((codes >= 0x3000) & (codes < 0x3040))] = 0
    out[codes == END] = END
    word = out > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    out[~word] = GAP
    at = np.flatnonzero(keep)
    return out[at], at


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Index:
    """The windows of a block of benchmark items and their q-grams."""

    item: np.ndarray  # per window: item id
    length: np.ndarray
    edits: np.ndarray  # budget k
    need: np.ndarray  # shared q-grams of a match, at least
    text: np.ndarray  # windows x longest, padded with 0
    grams: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # per q-gram: its places in the next two
    place_window: np.ndarray
    place_offset: np.ndarray
    seen: np.ndarray  # hash bitmap of the q-grams


def gram_numbers(codes: np.ndarray) -> np.ndarray:
    """The q-gram at each position as one number (q = 8 bytes)."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    two = codes[:-1].astype(np.uint16) | (codes[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


def build_index(items: list[tuple[int, str]], p: LeakParams) -> Index | None:
    rows = []
    for item, text in items:
        codes, _ = normalise(code_points(text or ""))
        codes = codes[codes != END]
        if len(codes) and codes[-1] == GAP:
            codes = codes[:-1]
        n = len(codes)
        if n < p.min_chars:
            continue
        starts = [0] if n <= p.window else [*range(0, n - p.window, p.stride), n - p.window]
        rows += [(item, codes[s : s + p.window]) for s in starts]
    if not rows:
        return None
    length = np.array([len(c) for _, c in rows])
    edits = np.minimum((length * p.budget + 1e-9).astype(int), (length - Q) // Q)
    text = np.zeros((len(rows), length.max()), np.uint8)
    g, w, o = [], [], []
    for i, (_, c) in enumerate(rows):
        text[i, : len(c)] = c
        x = gram_numbers(c)
        g.append(x)
        w.append(np.full(len(x), i))
        o.append(np.arange(len(x)))
    g, w, o = np.concatenate(g), np.concatenate(w), np.concatenate(o)
    order = np.argsort(g, kind="stable")
    grams, first = np.unique(g[order], return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[_slot(grams)] = True
    return Index(np.array([r[0] for r in rows]), length, edits, length - Q + 1 - edits * Q, text, grams, np.append(first, len(g)), w[order], o[order], seen)


def retained(codes: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, first diagonal) of every diagonal band that meets the q-gram bound."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_numbers(codes)
    at = np.flatnonzero(ix.seen[_slot(grams)])
    if not len(at):
        return none
    slot = np.minimum(np.searchsorted(ix.grams, grams[at]), len(ix.grams) - 1)
    real = ix.grams[slot] == grams[at]
    at, slot = at[real], slot[real]
    # A match has `least` of its positions within `reach`: others need no counting.
    least, reach = int(ix.need.min()), int((ix.length + ix.edits).max())
    if len(at) < least or not len(at):
        return none
    if least > 1:
        dense = at[least - 1 :] - at[: len(at) - least + 1] <= reach
        mark = np.zeros(len(at) + 1, np.int64)
        mark[np.flatnonzero(dense)] += 1
        mark[np.flatnonzero(dense) + least] -= 1
        inside = np.cumsum(mark[:-1]) > 0
        at, slot = at[inside], slot[inside]
        if not len(at):
            return none
    many = ix.first[slot + 1] - ix.first[slot]
    place = np.repeat(ix.first[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    window = ix.place_window[place]
    width = ix.edits[window] + 1
    diagonal = np.repeat(at, many) - ix.place_offset[place] + ix.text.shape[1]  # not negative
    band = diagonal // width
    span = int(band.max()) + 2
    # Each diagonal lies in two overlapping bands, band and band - 1.
    key, count = np.unique(np.concatenate([window * span + band, window * span + np.maximum(band - 1, 0)]), return_counts=True)
    window, band = key // span, key % span
    enough = count >= ix.need[window]
    window, band = window[enough], band[enough]
    return window, band * (ix.edits[window] + 1) - ix.text.shape[1]


def align(codes: np.ndarray, ix: Index, window: np.ndarray, diagonal: np.ndarray, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each window on the band of diagonals, and the passage's start and end."""
    edits, start, end = (np.empty(len(window), np.int64) for _ in range(3))
    for lo in range(0, len(window), chunk):
        w, d = window[lo : lo + chunk], diagonal[lo : lo + chunk]
        k = int(ix.edits[w].max())
        low, wide = d - k, 4 * k + 2  # the band and k more on either side
        step = np.arange(wide)
        unit = 1 << 12  # value: edits * unit + diagonal the passage began on
        v = np.broadcast_to(step, (len(w), wide)).astype(np.int32)
        best = np.full((len(w), wide), np.iinfo(np.int32).max, np.int32)
        step = step.astype(np.int32)
        around = np.concatenate([np.zeros(1, np.uint8), codes, np.zeros(1, np.uint8)])
        n = ix.length[w]
        for i in range(int(n.max())):
            at = low[:, None] + i + step
            x = around[np.clip(at + 1, 0, len(around) - 1)]
            nxt = v + np.where(x == ix.text[w, i][:, None], np.int32(0), np.int32(unit))
            nxt[:, :-1] = np.minimum(nxt[:, :-1], v[:, 1:] + unit)
            v = np.minimum.accumulate(nxt - unit * step, 1) + unit * step
            done = n == i + 1
            best[done] = v[done]
        j = best.argmin(1)
        value = best[np.arange(len(w)), j]
        edits[lo : lo + chunk] = value // unit
        start[lo : lo + chunk] = low + value % unit
        end[lo : lo + chunk] = low + n + j
    return edits, start, end


def leaks_in(texts: list[str], ix: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item, start, end, windows, edits) of each item found, offsets in code points."""
    codes, at = normalise(code_points(chr(END).join([*(t.replace(chr(END), " ") for t in texts), ""])))
    window, diagonal = retained(codes, ix)
    if not len(window):
        return []
    edits, start, end = align(codes, ix, window, diagonal)
    good = edits <= ix.edits[window]
    window, edits = window[good], edits[good]
    start, end = np.clip(start[good], 0, len(codes)), np.clip(end[good], 0, len(codes))
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    end = np.maximum(end, start + 1)
    middle = at[np.minimum((start + end) // 2, len(at) - 1)]
    doc = np.searchsorted(first, middle, "right") - 1
    found: dict[tuple[int, int], list] = {}
    for w, e, s, t, d in zip(window.tolist(), edits.tolist(), at[start].tolist(), (at[end - 1] + 1).tolist(), doc.tolist()):
        s, t = max(s, int(first[d])) - int(first[d]), min(t, int(first[d + 1]) - 1) - int(first[d])
        one = found.setdefault((d, int(ix.item[w])), [s, t, {}])
        one[0], one[1] = min(one[0], s), max(one[1], t)
        one[2][w] = min(e, one[2].get(w, e))
    return [(d, item, s, t, len(ws), sum(ws.values())) for (d, item), (s, t, ws) in sorted(found.items())]


def _finder(ix: Index, id_type: pa.DataType = pa.int64()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in textvec.blocks(texts, BLOCK_CHARS):
                rows = leaks_in(texts[lo:hi], ix)
                if rows:
                    columns = [list(c) for c in zip(*rows)]
                    columns[0] = [ids[lo + i] for i in columns[0]]
                    types = [id_type] + [pa.int64()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "item_id", "start", "end", "windows", "edits"])

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of at most ``block_chars`` characters (or one item)."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col)
    block, size = [], 0
    for item, text in items.orderBy(item_col, text_col).toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    params: LeakParams = LeakParams(),
) -> DataFrame:
    """One row per document and benchmark item found in it.

    ``id_col``, item_id, start, end (code points of the document's text, end
    exclusive), windows (of the item, that matched), edits (over them).
    Documents without a leak give no row; null and empty texts have none. Items
    without text or id, and those too short, match nothing. Repeated rows give
    repeated rows, an empty table none. Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _found(own, benchmark, item_col, item_text_col, params, T.LongType(), pa.int64()).withColumnRenamed("id", id_col)


def _found(own: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, params: LeakParams, kind: T.DataType, id_type: pa.DataType) -> DataFrame:
    shape = T.StructType([T.StructField("id", kind)] + [T.StructField(c, T.LongType()) for c in ("item_id", "start", "end", "windows", "edits")])
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col, params.block_chars):
        if (ix := build_index(block, params)) is not None:
            part = own.mapInArrow(lean(_finder(ix, id_type)), shape)
            out = part if out is None else out.unionByName(part)
    return own.sparkSession.createDataFrame([], shape) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LeakParams = LeakParams()) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; its columns are unchanged.

    The text decides: rows that share an id with such a row stay. Rows without an id
    stay, as do null and empty texts; repeated rows share their decision; an empty
    table, or an empty benchmark, changes nothing.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(text_digest(F.col(text_col)).alias("id"), F.col(text_col).alias("text"))
    leaked = _found(own, benchmark, "item_id", "text", params, T.StringType(), pa.string()).select(F.col("id").alias("sha")).distinct()
    named = F.when(F.col(id_col).isNotNull(), text_digest(F.col(text_col)))
    return drop_texts(docs, scratch.stage(leaked, "leaked"), named)
