"""Near-duplicates by SetSketch registers.

Each document's distinct word shingles are sketched into ``registers``
truncated minima: register i holds floor(1 - log_b(min over shingles of an
exponential variate)), so values are exponentially spaced and two sketches
merge by the register-wise maximum. Bands of ``rows`` registers are the
candidate keys. A candidate pair's Jaccard similarity is first estimated by
maximum likelihood from how many registers are greater, smaller and equal
together with both set sizes; pairs clearly under the threshold go, all others
are verified on their full shingle sets.

No group is ever expanded into all its pairs:

1. documents with equal shingle sets collapse to one representative;
2. star rounds: within a band bucket members are compared with one centre per
   round, each member with a single centre, and linked parts are contracted;
3. the exact rest: of each bucket only pairs from different components are
   compared, block by block inside the tasks on their sketches and on the
   leading bits of their sets; only those that may be linked leave the task.
   A first pass takes one pair a member and part, the second all that are
   then still in different parts.

Every pair that shares a band is so verified, or lies in one component, or has
an estimate far below the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import textvec
from churnscope.llm.common import BROADCAST_ROWS, Scratch, drop_ids, drop_texts, keep_ids, lean, one_of_each, sized, text_digest


@dataclass(frozen=True)
class SketchParams:
    """``words`` a shingle; link at ``percent`` similarity or more.

    At similarity 0.8 a pair shares none of 30 bands of 5 registers with a
    probability of 5e-6. ``more`` registers beside the bands' sharpen the
    estimate. ``slack``: estimates this far under the threshold are dropped
    unverified (4.3 standard deviations of 300 registers at 0.8, 2e-5). Star
    rounds end early once at most ``few`` comparisons per bucket member are
    left; results don't depend on their number. ``block`` members of a bucket
    are compared with as many others in one task.
    """

    words: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 30
    base: float = 1.1
    rate: float = 20.0
    more: int = 150
    slack: float = 0.1
    star_rounds: int = 2
    few: int = 3
    block: int = 1024

    @property
    def registers(self) -> int:
        return self.rows * self.bands + self.more


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, m + 1, dtype=np.uint64)
    return textvec.mix(n * np.uint64(0xD1342543DE82EF95)) | np.uint64(1), textvec.mix(n * np.uint64(0xA0761D6478BD642F))


def sketch(h: np.ndarray, starts: np.ndarray, p: SketchParams) -> np.ndarray:
    """Registers (documents x registers, uint8) of the sets that start at ``starts`` in ``h``."""
    out = np.empty((p.registers, len(starts)), np.uint8)
    for i, (a, b) in enumerate(zip(*_seeds(p.registers))):
        low = np.minimum.reduceat(h * a + b, starts)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-12)) / p.rate
        out[i] = np.clip(np.floor(1 - np.log(x) / np.log(p.base)), 0, 255)
    return out.T


def band_keys(registers: np.ndarray, p: SketchParams) -> np.ndarray:
    """A 64-bit key for each band of each document."""
    r = registers[:, : p.rows * p.bands].reshape(len(registers), p.bands, p.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(p.bands, dtype=np.uint64), r.shape[:2]).copy()
    for j in range(p.rows):
        key = textvec.mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j] + np.uint64(1))
    return key.view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").translate(textvec.LOWER_AZ) for t in column.to_pylist()]


def _signer(p: SketchParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), _texts(batch.column(1))
            for lo, hi in textvec.blocks(texts):
                h, of = textvec.shingles(texts[lo:hi], p.words)
                n = np.bincount(of, minlength=hi - lo)
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                digest, keys, regs = [None] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo)
                if len(full):
                    r = sketch(h, starts, p)
                    for i, s, k, x in zip(full, starts, band_keys(r, p).tolist(), r):
                        digest[i] = hashlib.blake2b(h[s : s + n[i]].tobytes(), digest_size=16).digest()
                        keys[i], regs[i] = k, x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                    names=["id", "n_shingles", "digest", "keys", "regs"],
                )

    return run


def _compact(h: np.ndarray) -> bytes:
    """The leading bits of a sorted set: 16 of each number, 32 in sets over 1,024."""
    return ((h >> np.uint64(48)).astype(np.uint16) if len(h) <= 1024 else (h >> np.uint64(32)).astype(np.uint32)).tobytes()


def _may_link(x: bytes, y: bytes, nx: int, ny: int, percent: int) -> bool:
    """Whether compact sets allow the similarity. Equal numbers have equal bits, so no link is lost."""
    a, b = (np.frombuffer(c, np.uint16 if n <= 1024 else np.uint32) for c, n in ((x, nx), (y, ny)))
    if a.dtype != b.dtype:
        a, b = (c if c.dtype == np.uint16 else (c >> np.uint32(16)).astype(np.uint16) for c in (a, b))
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (nx + ny - both)


def _setter(p: SketchParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), _texts(batch.column(1))
            for lo, hi in textvec.blocks(texts):
                h, of = textvec.shingles(texts[lo:hi], p.words)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=hi - lo))])
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
                compact = pa.array([_compact(h[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), sets, compact], names=["id", "items", "compact"])

    return run


def likely_similarity(greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float, grid: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (base - 1) / base) / np.log(base)
    more, less = p(u - v * j), p(v - u * j)
    same = np.clip(1 - more - less, 1e-12, 1)
    score = greater[:, None] * np.log(more) + smaller[:, None] * np.log(less) + equal[:, None] * np.log(same)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def reaches(similarity: float, greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Whether the likeliest similarity is at least ``similarity``, which the set sizes must allow.

    The likelihood has one peak, so the sign of its slope there tells.
    """
    u = na / (na + nb)
    v = 1 - u
    c, scale = (base - 1) / base, np.log(base)
    x, y = np.maximum(u - v * similarity, 1e-12), np.maximum(v - u * similarity, 1e-12)
    more, less = -np.log1p(-c * x) / scale, -np.log1p(-c * y) / scale
    dmore, dless = -v * c / (1 - c * x) / scale, -u * c / (1 - c * y) / scale
    return greater * dmore / more + smaller * dless / less - equal * (dmore + dless) / np.maximum(1 - more - less, 1e-12) >= 0


def _close(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, p: SketchParams) -> np.ndarray:
    """Whether the estimated similarity of pairs is not far below the threshold."""
    least = p.percent / 100 - p.slack
    out = 100 * np.minimum(na, nb) >= p.percent * np.maximum(na, nb)  # sizes alone bound it
    equal = (ra == rb).sum(1)
    # Registers are equal at least as often as the sets are similar: clear cases need no estimate.
    out &= equal >= (least - p.slack) * p.registers
    at = np.flatnonzero(out)
    if len(at):
        greater = (ra[at] > rb[at]).sum(1)
        out[at] = reaches(least, greater, p.registers - equal[at] - greater, equal[at], na[at], nb[at], p.base)
    return out


def _registers(column: pa.Array, p: SketchParams) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, p.registers)


def _likely(p: SketchParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (a, b, na, nb, ra, rb, pa, pb) the pairs whose estimate is not far below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                mask = pa.array(_close(_registers(batch.column(4), p), _registers(batch.column(5), p), na, nb, p))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1, 6, 7)], names=["a", "b", "pa", "pb"])

    return run


def _in_buckets(p: SketchParams, best: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of different parts that may be linked, within buckets' blocks.

    Rows (key, lo, hi, block, id, part, n, regs, compact) come sorted by (key,
    lo, hi); a group holds the members of two blocks of a bucket, ``2 *
    p.block`` or so. Pairs pass the estimate, then the compact sets' upper
    bound. ``best``: of a member's pairs with one part, only the first.
    """

    def pairs(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, lo, hi, block, ids, part, n, regs, compact = rows
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.cumsum(new)
        width = p.rows * p.bands
        band = np.concatenate([(band_keys(regs[s : s + 4096], p) == key[s : s + 4096, None]).argmax(1) for s in range(0, len(key), 4096)])
        out: list[tuple[int, int]] = []
        done: set[tuple[int, int]] = set()
        for d in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero(group[d:] == group[:-d])
            i = i[(part[i] != part[i + d]) & ((lo[i] == hi[i]) | (block[i] != block[i + d]))]
            for s in range(0, len(i), 4096):
                x, y = i[s : s + 4096], i[s : s + 4096] + d
                # A pair that shares several bands is compared in the first of them only.
                first = (regs[x, :width] == regs[y, :width]).reshape(len(x), p.bands, p.rows).all(2).argmax(1)
                own = first == band[x]
                x, y = x[own], y[own]
                near = _close(regs[x], regs[y], n[x], n[y], p)
                x, y = x[near], y[near]
                for a, b in zip(x.tolist(), y.tolist()):
                    if best and (int(ids[a]), int(part[b])) in done and (int(ids[b]), int(part[a])) in done:
                        continue
                    if _may_link(compact[a], compact[b], int(n[a]), int(n[b]), p.percent):
                        out.append((a, b))
                        done |= {(int(ids[a]), int(part[b])), (int(ids[b]), int(part[a]))}
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[x], ids[y], part[x], part[y])], names=["a", "b", "pa", "pb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, 16384):
                batch = whole.slice(at, 16384)
                rows = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)), _registers(batch.column(7), p), np.array(batch.column(8).to_pylist(), object))
                if kept is not None:
                    rows = tuple(np.concatenate(x) for x in zip(kept, rows))
                # The last group may go on in the next batch.
                last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
                kept = tuple(x[last] for x in rows)
                if not last.all():
                    yield pairs(tuple(x[~last] for x in rows))
        if kept is not None:
            yield pairs(kept)

    return run


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, label): for every end of ``edges`` (a, b) the smallest id it is connected with.

    Each round all nodes of one label take the least among their label's own
    label and the labels next to any of them, so whole parts are hooked onto
    each other and the rounds grow with the logarithm of the longest path.
    Labels only fall, so the rounds end; each is one staged job. Labels never
    go to the driver.
    """
    both = scratch.stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = scratch.stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "cc-labels")
    n = labels.count()
    while True:
        near = both.join(sized(labels.select(F.col("id").alias("b"), "label"), n), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hook = near.join(sized(labels.select("id", "label"), n), "id").groupBy("label").agg(F.min("near").alias("hook"))
        far = sized(labels.select(F.col("id").alias("label"), F.col("label").alias("far")), n)
        step = sized(hook.join(far, "label").select("label", F.least("label", "hook", "far").alias("least")), n)
        after = labels.select("id", "label").join(step, "label").select("id", F.col("least").alias("label"), (F.col("least") < F.col("label")).alias("moved"))
        after = scratch.stage(after, "cc-labels")
        scratch.drop([labels])
        labels = after
        if labels.where("moved").isEmpty():
            break
    scratch.drop([both])
    return labels.select("id", "label")


PAIR = "a long, b long, pa long, pb long"


class _Verifier:
    """Verifies candidate pairs; keeps the sketches and the candidates' full sets staged."""

    def __init__(self, scratch: Scratch, signed: DataFrame, sets: DataFrame, p: SketchParams):
        self.scratch, self.p, self.sets = scratch, p, sets.select("id", "items")
        self.regs = signed.select("id", "n_shingles", "regs")
        self.compact = sets.select("id", "compact")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of distinct ``pairs`` (a, pa, b, pb) those whose sketches say they may be linked."""
        ra = self.regs.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"))
        rb = self.regs.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))
        seen = pairs.join(ra, "a").join(rb, "b").select("a", "b", "na", "nb", "ra", "rb", "pa", "pb")
        return seen.mapInArrow(lean(_likely(self.p)), PAIR)

    def between_parts(self, members: DataFrame, best: bool = False) -> DataFrame:
        """All pairs that share a bucket, lie in different parts and may be linked.

        ``best``: one pair a member and part in each block, which is enough to
        link most parts; the exact answer takes all.
        """
        p = self.p
        open_ = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1")
        blocks = F.ceil(F.col("n") / p.block).cast("int")
        rows = members.join(open_.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "part")
        rows = rows.join(self.regs, "id").join(self.compact, "id")
        rows = rows.select("key", "lo", "hi", "block", "id", "part", "n_shingles", "regs", "compact")
        dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        return dealt.mapInArrow(lean(_in_buckets(p, best)), PAIR).distinct()

    def links(self, likely: DataFrame) -> DataFrame:
        """Of pairs (a, b, pa, pb) the linked ones' parts (a, b), staged: verified on the full sets."""
        p = self.p
        likely = self.scratch.stage(likely, "near-likely")
        sa = self.sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        sb = self.sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        linked = (100 * both) >= (p.percent * (F.size("x") + F.size("y") - both))
        found = likely.join(sa, "a").join(sb, "b").where(linked).select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        out = self.scratch.stage(found, "near-links")
        self.scratch.drop([likely])
        return out


def _contract(scratch: Scratch, members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, id, part) with linked parts made one."""
    labels = components(scratch, links)
    known = sized(labels.select(F.col("id").alias("part"), "label"))
    now = members.join(known, "part", "left").select("key", "id", F.coalesce("label", "part").alias("part"))
    out = scratch.stage(now, "near-members")
    scratch.drop([members])
    return out


def _cross_pairs(members: DataFrame) -> int:
    """Pairs of members of one bucket that lie in different components, over all buckets."""
    parts = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    per = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return per.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0.0))).first()[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SketchParams = SketchParams()) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept.

    Lower-cases A-Z; words are runs of other than white space. A text with
    fewer words than a shingle has its whole sequence as one; one without
    words (or null) is empty and linked with nothing. component_id is the
    smallest id reachable over links; kept marks the row of that id. Rows
    without an id are linked with nothing, have a null component and are kept.
    Rows that repeat an id are one node of the graph. An empty table gives no
    rows; other columns are not read.
    """
    p, scratch = params, Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.stage(own.mapInArrow(lean(_signer(p)), "id long, n_shingles long, digest binary, keys array<long>, regs binary"), "near-sketches")
    solid = signed.where("n_shingles > 0 and id is not null")
    same = scratch.stage(solid.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "near-same")
    copies = scratch.stage(solid.select("id", "digest").join(same.where("n > 1"), "digest").where("id <> rep").select("id", "rep").distinct(), "near-copies")
    reps = drop_ids(solid, copies.select("id"), "id")

    exploded = reps.select("id", F.explode("keys").alias("key"))
    buckets = scratch.stage(exploded.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "near-buckets")
    members = scratch.stage(exploded.join(sized(buckets), "key", "left_semi").select("key", "id", F.col("id").alias("part")), "near-members")
    candidates = scratch.stage(members.select("id").distinct(), "near-candidates")
    sets = scratch.stage(keep_ids(own.where("id is not null"), candidates, "id").mapInArrow(lean(_setter(p)), "id long, items array<long>, compact binary"), "near-sets")
    verify = _Verifier(scratch, keep_ids(signed, candidates, "id"), sets, p)

    for r in range(p.star_rounds):
        if r and _cross_pairs(members) <= p.few * members.count():
            break
        # One centre per bucket, another each round; one comparison per member.
        rank = F.struct(F.xxhash64(F.lit(r), "id") if r else F.lit(0).cast("long"), "id", "part")
        centres = members.groupBy("key").agg(F.min(rank).alias("c")).select("key", F.col("c").getField("id").alias("b"), F.col("c").getField("part").alias("pb"))
        pairs = members.join(centres, "key").where("part <> pb").groupBy(F.col("id").alias("a"), F.col("part").alias("pa")).agg(F.min(F.struct("b", "pb")).alias("c"))
        found = verify.links(verify.likely(pairs.select("a", "pa", "c.b", "c.pb")))
        if not found.isEmpty():
            members = _contract(scratch, members, found)
    for best in (True, False):
        found = verify.links(verify.between_parts(members, best))
        if not found.isEmpty():
            members = _contract(scratch, members, found)
    labels = scratch.stage(members.where("id <> part").select("id", F.col("part").alias("label")).distinct(), "near-labels")

    scratch.drop([same, buckets, members, candidates, sets])  # the result reads the others
    node = copies.select("id", F.col("rep").alias("node"))
    labels = labels.select(F.col("id").alias("node"), "label")
    out = signed.select("id", "n_shingles").join(sized(node), "id", "left")
    out = out.withColumn("node", F.coalesce("node", "id")).join(sized(labels), "node", "left")
    component = F.coalesce("label", "node")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SketchParams = SketchParams()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; its columns are unchanged.

    The row of the smallest id stays, of rows that repeat id and text one. Rows
    that share an id with another text are nodes of their own under negative
    numbers, and stay before the others of their group. Rows without an id, and
    texts without words, stay. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    sha = text_digest(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), sha.alias("sha")).where("id is not null").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n"))
    texts = scratch.stage(texts, "near-texts")
    several = texts.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("id")
    # Numbers of a written table: read again, they are the same.
    shared = texts.join(several, "id", "left_semi").select("id", "sha", (-1 - F.monotonically_increasing_id()).alias("node"))
    shared = scratch.stage(shared, "near-shared")
    own = docs.select(F.col(id_col).cast("long").alias("id"), sha.alias("sha"), F.col(text_col).alias("text"))
    if shared.isEmpty():
        own = own.withColumn("node", F.col("id"))
    else:
        own = own.join(sized(shared), ["id", "sha"], "left").withColumn("node", F.coalesce("node", "id"))
    gone = near_duplicates(own.select("node", "text"), "node", "text", params).where("not kept").select("node").distinct()
    gone = scratch.stage(gone, "near-gone")
    nodes = texts.join(sized(shared), ["id", "sha"], "left").select("id", "sha", "n", F.coalesce("node", "id").alias("node"))
    out_of = scratch.stage(nodes.join(sized(gone), "node", "left_semi").select("sha", "id"), "near-dropped")
    stay = scratch.stage(nodes.where("n > 1").join(sized(gone), "node", "left_anti").select("sha", "id"), "near-repeated")
    scratch.drop([texts, shared, gone])
    return one_of_each(drop_texts(docs, out_of, sha, id_col), stay, sha, id_col)


__all__ = ["BROADCAST_ROWS", "SketchParams", "band_keys", "components", "drop_near_copies", "likely_similarity", "near_duplicates", "sketch"]
