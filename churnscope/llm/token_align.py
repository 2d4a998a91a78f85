"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes; where a token of A and a token of B end at
the same offset both cut, and the tokens between two such places form a group.
Finding them is a merge of the two sorted lists of ends:

* Merge path. The merge of lists of lengths m and n is a path through an m x n
  grid. Binary searches along evenly spaced diagonals cut it into pieces of equal
  work, whatever the lists look like; each piece is merged by itself and gives
  its overlaps (common ends) and the groups within it. A group that is open at a
  piece's border goes on in the next piece: adding up the pieces' overlaps
  stitches the numbers together.
* Blocks. Documents are aligned in blocks (``block_bytes`` of text). Both tokenizers begin a
  token at each lone space, so texts are cut there; equal parts have equal tokens
  and groups, and each distinct part of a block is tokenised and merged once.
* Counts. Which pairs a document links is known within its block, as slots of
  the block's pair list. Spark adds up, over all blocks, how many documents hold
  each pair, finds each A id's highest count, and joins the counts back to the
  slots of each block. What is shuffled are the distinct pairs of blocks, not those
  of documents; a pair that every document holds comes once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import tokens
from churnscope.llm.common import Scratch, give_back, lean

#: Entries worked on at once where lists are multiplied out; pairs in one row of a block's list, and tokens written at once.
CHUNK, ROW = 1 << 19, 1 << 16
#: Distinct parts of a block that are tokenised and merged at once: what that takes besides its results is bounded by them.
PARTS = 1 << 15

STAGED = (
    "part string, block long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "parts binary, slots binary, times binary, sizes binary, first int, a array<int>, b array<int>, docs array<long>"
)
RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


@dataclass(frozen=True)
class AlignParams:
    """``work``: ends merged in one piece. ``digest``: SHA-256 of the groups in place of their text."""

    block_bytes: int = 8 << 20
    work: int = 1 << 16
    digest: bool = False


def diagonal(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` values of the merge of ``a`` and ``b`` come from ``a``, for all ``d`` at once; equal ones: a's first."""
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = np.zeros(len(d), bool)
        before[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low


def borders(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of ``work`` entries begin and end in both lists. A value that both hold is never parted."""
    d = np.minimum(np.arange(0, len(a) + len(b) + work, work), len(a) + len(b))
    i = diagonal(a, b, d)
    j = d - i
    if len(a) and len(b):
        parted = (i > 0) & (j < len(b)) & (a[i - 1] == b[np.minimum(j, len(b) - 1)])
        j = j + parted
    return i, j


def merge_piece(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of both lists how many overlaps come before it, and the overlaps of the piece."""
    if not len(x) or not len(y):
        return np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    in_x = y[at] == x
    in_y = np.zeros(len(y), bool)
    in_y[at[in_x]] = True
    return np.cumsum(in_x) - in_x, np.cumsum(in_y) - in_y, int(in_x.sum())


def group_numbers(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token, from the strictly increasing ends of both tokenizers."""
    i, j = borders(a, b, work)
    ga, gb, base = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 0
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:]):
        x, y, n = merge_piece(a[i0:i1], b[j0:j1])
        ga[i0:i1], gb[j0:j1] = x + base, y + base
        base += n
    return ga, gb


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts, first)


def _cuts(sizes: np.ndarray, limit: int) -> list[int]:
    """Borders of runs of ``sizes`` that sum up to about ``limit``."""
    if not len(sizes):
        return [0]
    run = (np.cumsum(sizes) - 1) // limit
    return [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]


class Aligner:
    """Aligns the distinct parts of blocks with a pair of tokenizers."""

    RESULTS = {"good": bool} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "owner", "pair", "times"), np.int64)

    def __init__(self, a: tokens.ByteLevelBpe, b: tokens.PieceBpe, work: int):
        if not b.splits_at_spaces:
            raise ValueError("a piece of B holds a space behind another character: texts can't be cut at spaces")
        self.a, self.b, self.work = a, b, work
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        text = [str(i).encode() for i in range(max(len(a.bytes), len(b.bytes)))]
        #: What each token adds to a group's text: A's within and at the end of their side, then B's.
        self.pieces = [x + end for n, ends in ((len(a.bytes), b",|"), (len(b.bytes), b",;")) for end in (ends[:1], ends[1:]) for x in text[:n]]
        self.piece_size = np.array([len(x) for x in self.pieces], np.int64)

    def _whole(self, parts: list[str], a: tokens.Encoded, b: tokens.Encoded) -> np.ndarray:
        """Parts whose joined bytes are the text's in both encodings."""
        good = np.ones(len(parts), bool)
        want = [b" " + p.encode("utf-8") for p in parts]
        length, whole = np.fromiter(map(len, want), np.int64, len(want)), b"".join(want)
        for coded, t, size in ((a, self.a, self.size_a), (b, self.b, self.size_b)):
            listed = list(map(t.bytes.__getitem__, coded.ids.tolist()))
            per = np.concatenate([[0], np.cumsum(size[coded.ids])])[np.concatenate([coded.starts, [len(listed)]]).astype(np.int64)]
            if np.array_equal(np.diff(per), length) and b"".join(listed) == whole:
                continue
            ends = (coded.starts + coded.counts).tolist()
            good &= [b"".join(listed[s:e]) == w for s, e, w in zip(coded.starts.tolist(), ends, want)]
        return good

    def align(self, parts: list[str]) -> None:
        """Sets good, n_a, n_b, n_groups, n_links and text of each part, and its distinct pairs: (owner, pair, times)."""
        found = {name: [np.zeros(0, kind)] for name, kind in self.RESULTS.items()}
        text = []
        for lo in range(0, len(parts), PARTS):
            self._align(parts[lo : lo + PARTS])
            self.owner += lo
            text += self.text
            for name, arrays in found.items():
                arrays.append(getattr(self, name))
        self.text = text
        for name in self.RESULTS:
            setattr(self, name, np.concatenate(found.pop(name)))

    def forget(self) -> None:
        """Drops the results of the last block."""
        self.align([])

    def _align(self, parts: list[str]) -> None:
        a, b = self.a.encode([" " + p for p in parts]), self.b.encode(parts)
        self.good = self._whole(parts, a, b)
        ids_a, ids_b = a.ids[np.repeat(self.good, a.counts)], b.ids[np.repeat(self.good, b.counts)]
        self.n_a, self.n_b = np.where(self.good, a.counts, 0), np.where(self.good, b.counts, 0)
        of_a = np.repeat(np.arange(len(parts)), self.n_a)
        ga, gb = group_numbers(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]), self.work)
        groups = int(ga[-1]) + 1 if len(ga) else 0
        per_a, per_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        owner = of_a[first_a] if groups else np.zeros(0, np.int64)
        self.n_groups = np.bincount(owner, minlength=len(parts))
        self.n_links = np.zeros(len(parts), np.int64)
        np.add.at(self.n_links, owner, per_a * per_b)
        self._texts(ids_a, ids_b, ga, gb, per_a, per_b, first_a, first_b)
        self._pairs(ids_a, ids_b, of_a, ga, per_b, first_b)

    def _texts(self, ids_a, ids_b, ga, gb, per_a, per_b, first_a, first_b) -> None:
        na, nb = len(self.a.bytes), len(self.b.bytes)
        i, j = np.arange(len(ids_a)), np.arange(len(ids_b))
        code = np.empty(len(i) + len(j), np.int64)
        code[i + first_b[ga]] = ids_a + na * (i == first_a[ga] + per_a[ga] - 1)
        code[j + first_a[gb] + per_a[gb]] = 2 * na + ids_b + nb * (j == first_b[gb] + per_b[gb] - 1)
        runs = (code[i : i + ROW].tolist() for i in range(0, len(code), ROW))
        whole = b"".join(b"".join(map(self.pieces.__getitem__, run)) for run in runs)
        ends = np.concatenate([[0], np.cumsum(self.piece_size[code])])[np.cumsum(self.n_a + self.n_b)].tolist()
        self.text = [whole[s:e] for s, e in zip([0, *ends], ends)]

    def _pairs(self, ids_a, ids_b, of_a, ga, per_b, first_b) -> None:
        reach, span = per_b[ga], len(self.a.bytes) * len(self.b.bytes)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cut = _cuts(reach, CHUNK)
        for lo, hi in zip(cut, cut[1:]):
            n = reach[lo:hi]
            other = ids_b[tokens.spread(first_b[ga[lo:hi]], n)].astype(np.int64)
            base = of_a[lo:hi] * span + ids_a[lo:hi].astype(np.int64) * len(self.b.bytes)
            k, c = np.unique(np.repeat(base, n) + other, return_counts=True)
            keys.append(k)
            counts.append(c)
        keys, self.times = _added(np.concatenate(keys), np.concatenate(counts))
        self.owner, self.pair = keys // span, keys % span


def _document_counts(parts: tokens.Parts, valid: np.ndarray, sizes: np.ndarray, starts: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """In how many of the ``valid`` documents each slot occurs."""
    out = np.zeros(n, np.int64)
    seen = valid[parts.of]
    held = np.unique(parts.of[seen] * np.int64(len(sizes)) + parts.index[seen])
    doc, part = held // len(sizes), held % len(sizes)
    # A document's slots are told apart within one run, so runs end where documents do.
    per_doc = np.bincount(doc, weights=sizes[part], minlength=len(valid)).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(valid)))])
    cut = _cuts(per_doc, CHUNK)
    for lo, hi in zip(cut, cut[1:]):
        d, p = doc[edge[lo] : edge[hi]], part[edge[lo] : edge[hi]]
        found = np.repeat(d * np.int64(n), sizes[p]) + slots[tokens.spread(starts[p], sizes[p])]
        out += np.bincount(np.unique(found) % n, minlength=n) if n else 0
    return out


def _rows(part: str, block: int, n: int, **columns) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in STAGED.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {"array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    columns |= {"part": [part] * n, "block": [block] * n}
    types = [kinds[x.strip().split(" ")[1]] for x in STAGED.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)


def _block_rows(aligner: Aligner, block: int, ids: pa.Array, texts: pa.Array, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: documents, the pairs of their parts, and the block's distinct pairs with their documents."""
    ids, texts, parts = tokens.split_at_spaces(ids, texts)
    aligner.align(parts.values)
    filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    valid = filled & (parts.total(~aligner.good) == 0)
    pairs, slots = np.unique(aligner.pair, return_inverse=True)
    sizes = np.bincount(aligner.owner, minlength=len(parts.values))
    docs = _document_counts(parts, valid, sizes, np.cumsum(sizes) - sizes, slots, len(pairs))
    groups, held = [], []
    for ok, s, n in zip(valid.tolist(), parts.starts.tolist(), parts.sizes.tolist()):
        index = parts.index[s : s + n]
        text = b"".join(map(aligner.text.__getitem__, index.tolist()))[:-1] if ok else b""
        groups.append(hashlib.sha256(text).hexdigest() if digest and ok else text.decode())
        # Sorted, as steps: small numbers, which compress well.
        held.append(np.diff(np.sort(index), prepend=0).astype("<i4").tobytes() if ok else b"")
    sums = {c: np.where(valid, parts.total(getattr(aligner, c)), 0) for c in ("n_a", "n_b", "n_groups", "n_links")}
    yield _rows("document", block, len(ids), id=ids, groups=groups, parts=held, **sums)
    blobs = {"slots": slots.astype("<i4"), "times": aligner.times.astype("<i8"), "sizes": sizes.astype("<i4")}
    yield _rows("part", block, 1, **{k: [v.tobytes()] for k, v in blobs.items()})
    for lo in range(0, len(pairs), ROW):
        at = slice(lo, lo + ROW)
        a, b = np.divmod(pairs[at], len(aligner.b.bytes))
        yield _rows("pair", block, 1, first=[lo], a=[a.astype(np.int32)], b=[b.astype(np.int32)], docs=[docs[at]])


def _staging(spec_a, spec_b, p: AlignParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokens.ByteLevelBpe(spec_a.value), tokens.PieceBpe(spec_b.value), p.work)
        block = TaskContext.get().partitionId() << 32
        for ids, texts in tokens.blocks(batches, p.block_bytes):
            yield from _block_rows(aligner, block, ids, texts, p.digest)
            del ids, texts
            # Before the next block, what this one took goes back to the system; kept, it would add up to the next one's.
            aligner.forget()
            give_back()
            block += 1

    return run


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links, from the counts of the block's pairs."""
    kind = left.column("part")
    documents = left.filter(pc.equal(kind, "document")).combine_chunks()
    part = left.filter(pc.equal(kind, "part")).slice(0, 1).to_pylist()[0]
    read = lambda c, t: np.frombuffer(part[c], t)
    slots, times, sizes = read("slots", "<i4"), read("times", "<i8"), read("sizes", "<i4").astype(np.int64)
    n = int(slots.max()) + 1 if len(slots) else 0
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = right.column("slot").to_numpy()
    count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy().astype(np.int64)
    per_part = []
    for value in (count, best):
        run = np.concatenate([[0], np.cumsum(value[slots] * times)])
        ends = np.cumsum(sizes)
        per_part.append(run[ends] - run[ends - sizes])
    held = [np.cumsum(np.frombuffer(x, "<i4")) for x in documents.column("parts").to_pylist()]
    sums = [[int(v[h].sum()) for h in held] for v in per_part]
    c = {k: documents.column(k) for k in ("id", "n_a", "n_b", "n_groups", "n_links", "groups")}
    return pa.table({**{k: c[k] for k in list(c)[:5]}, "n_best": pa.array(sums[1], pa.int64()), "count_sum": pa.array(sums[0], pa.int64()), "groups": c["groups"]})


def align_tokens(
    docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text", params: AlignParams = AlignParams()
) -> DataFrame:
    """One row per document: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``byte_bpe`` is the path of a byte-level BPE (``tokenizers`` JSON, A), which encodes
    space + text, ``piece_bpe`` that of a piece BPE with byte fallback (B), which puts the
    space itself. ``groups`` lists the groups in order, ``a1,a2|b1;a3|b2,b3`` in
    decimal ids (``params.digest``: its SHA-256). Links are all pairs of an A and a B
    token of one group. A pair's count is the number of documents that hold it
    linked, each row of ``docs`` being a document; ``count_sum`` adds up the
    counts over a document's links, ``n_best`` counts the links whose count is the
    highest of their A id, ties included.

    Null and empty texts, and texts that one of the tokenizers does not give back
    byte for byte, have no tokens: zeros, and empty ``groups``. Repeated rows and rows
    without an id are documents like any others, an empty table gives no
    rows. Other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    specs = [spark.sparkContext.broadcast(tokens.read_file(p)) for p in (byte_bpe, piece_bpe)]
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    staged = scratch.stage(narrow.mapInArrow(lean(_staging(*specs, params)), STAGED), "align-blocks", compression="zstd")
    listed = F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "pair")
    pairs = staged.where("part = 'pair'").select("block", "first", listed).select(
        "block", (F.col("first") + F.col("at")).alias("slot"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.col("pair.docs").alias("docs")
    )
    # Pairs that only documents without tokens hold count nowhere.
    held = pairs.where("docs > 0")
    counts = scratch.stage(held.groupBy("a", "b").agg(F.sum("docs").alias("count")), "align-counts")
    # One row an A id: bounded by its vocabulary.
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    known = counts.join(F.broadcast(top), "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    back = held.join(known, ["a", "b"]).select(F.col("block").alias("of"), "slot", "count", "best")
    blocks = staged.where("part <> 'pair'").select("part", "block", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "parts", "slots", "times", "sizes")
    out = blocks.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_finish, RESULT)
    return out.withColumnRenamed("id", id_col)
