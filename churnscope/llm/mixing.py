"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Among all document rates that meet the
targets, entropy balancing takes the one closest to "every document once" in
relative entropy: rate = exp(lambda_source * size / mean size), at most
``cap``. The multipliers solve a convex dual with one variable per source;
Newton steps (safeguarded by a bracket) run as Spark aggregations over the
(source, size) histogram. Rates become whole copies by carrying the rounding
from size to size within a source, followed by corrections with ever smaller
documents, so a source's words end near its target.

Only built-in functions. Sums that steer the result are exact decimals, hence
independent of partitioning: reruns agree. A hot source costs no more than its
number of different sizes; a hot (source, size) cell is ranked in buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from churnscope.llm.common import NOT_WHITE, Scratch, sized


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources by code point (null last); ``cap`` copies a document at most.

    Newton stops when every source is within ``tolerance`` of its target;
    ``bucket_rows`` documents of a cell are ranked in one task.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    cap: int = 3
    tolerance: float = 1e-7
    newton_steps: int = 80
    corrections: int = 5
    bucket_rows: int = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WHITE)), F.lit(0)).cast("long")


def targets(cells: DataFrame, p: MixParams) -> DataFrame:
    """Per source: source_size, target and what Newton needs. One row a source."""
    by = cells.groupBy("src", "source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("worded"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
    )
    # Sources are few beside documents: one row each, so these windows are small.
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in p.weights]), (place % len(p.weights)) + 1)
    by = by.withColumn("weight", weight.cast("long"))
    limit = F.col("source_size") * p.cap
    fill = W.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(limit).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - before) / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("full", limit <= F.col("level") * F.col("weight"))
    # The first source that is not full sets the level of all that are not.
    water = F.min(F.when(~F.col("full"), F.struct((limit / F.col("weight")).alias("r"), "source", "level"))).over(W.partitionBy())
    target = F.when(F.col("full"), limit.cast("double")).otherwise(water["level"] * F.col("weight"))
    return by.withColumn("target", target).select("src", "source", "source_size", "target", "worded", "least_size")


def rate(size: Column, lam: Column, mean: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(50.0))))


def solve(scratch: Scratch, cells: DataFrame, sources: DataFrame, p: MixParams) -> DataFrame:
    """``sources`` with each source's multiplier ``lam`` and mean size ``mean``."""
    mean = F.col("source_size") / F.col("worded")
    ratio = F.col("target") / F.col("source_size")
    # At these ends every rate is at most, or at least, the ratio that is needed.
    low = F.when(ratio < 1, F.log(ratio) * mean / F.col("least_size")).otherwise(0.0)
    high = F.when(ratio > 1, F.log(F.lit(float(p.cap))) * mean / F.col("least_size")).otherwise(0.0)
    state = sources.where("source_size > 0").withColumns({"mean": mean, "lo": low, "hi": high})
    settled = F.abs(F.col("target") - p.cap * F.col("source_size")) <= p.tolerance * F.col("target")
    state = scratch.stage(state.withColumn("lam", F.when(settled, F.col("hi")).otherwise(0.0)).withColumn("off", F.lit(1.0)), "mix-newton")
    worded = scratch.stage(cells.where("size > 0").select("src", "size", "n"), "mix-worded")
    for _ in range(p.newton_steps):
        r = rate(F.col("size"), F.col("lam"), F.col("mean"), p.cap)
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)")
        now = worded.join(sized(state.select("src", "lam", "mean")), "src").groupBy("src").agg(
            F.sum(words * r.cast("decimal(14,12)")).cast("double").alias("got"),
            F.sum(F.when(r < p.cap, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r).otherwise(0.0).cast("decimal(38,8)")).cast("double").alias("slope"),
        )
        short = F.col("got") < F.col("target")
        lo, hi = F.when(short, F.col("lam")).otherwise(F.col("lo")), F.when(short, F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        newton = F.when((F.col("slope") > 0) & (F.col("got") > 0), newton)
        off = F.abs(F.col("got") - F.col("target")) / F.col("target")
        stepped = state.drop("off").join(now, "src").withColumns({"lo2": lo, "hi2": hi, "newton": newton, "off": F.when(settled, 0.0).otherwise(off)})
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
        lam = F.when(F.col("off") <= p.tolerance, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        nxt = stepped.select("src", "source", "source_size", "target", "worded", "least_size", "mean", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), lam.alias("lam"), "off")
        nxt = scratch.stage(nxt, "mix-newton")
        scratch.drop([state])
        state = nxt
        if not (state.agg(F.max("off")).first()[0] or 0) > p.tolerance:
            break
    return state


def whole_copies(cells: DataFrame, solved: DataFrame, p: MixParams) -> DataFrame:
    """``cells`` with ``copies``: how many the documents of a cell get together."""
    own = cells.join(sized(solved.select("src", "lam", "mean", "target")), "src", "left")
    r = rate(F.col("size"), F.col("lam"), F.col("mean"), p.cap)
    wanted = F.when(F.col("size") > 0, F.col("n").cast("decimal(18,0)") * r.cast("decimal(14,12)")).otherwise(F.col("n").cast("decimal(18,0)"))
    order = W.partitionBy("src").orderBy(F.col("size").desc())
    upto = F.sum(F.when(F.col("size") > 0, wanted).otherwise(F.lit(0).cast("decimal(18,0)"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("upto", F.floor(upto).cast("long"))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0))
    own = own.withColumn("copies", F.when(F.col("size") > 0, F.least(copies, F.col("n") * p.cap)).otherwise(F.col("n")))
    whole = W.partitionBy("src")
    for _ in range(p.corrections):
        # Words missing (positive) or too many; filled up from the largest documents that fit.
        own = own.withColumn("rest", F.coalesce(F.round("target").cast("long"), F.lit(0)) - F.sum(F.col("copies") * F.col("size")).over(whole))
        room = F.when(F.col("rest") > 0, F.col("n") * p.cap - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest"))
        own = own.withColumn("room", F.when(fits, room).otherwise(0))
        used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        own = own.withColumn("used", used)
        take = F.least("room", F.floor((F.abs("rest") - F.col("used")) / F.greatest("size", F.lit(1))).cast("long"))
        own = own.withColumn("copies", F.col("copies") + F.signum("rest").cast("long") * F.greatest(take, F.lit(0)))
    return own.select("src", "size", "n", "copies")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """One row per document: ``id_col``, size, source_size, target, copies, taken.

    size counts the text's words (null: 0), taken = copies * size. Targets:
    sources by code point, null last, weigh ``weights`` in turn and share all
    words; a target stops at ``cap`` times its source's size, the excess goes
    to the others by weight. A document without words keeps one copy and takes
    nothing; a source without words has target 0. Which documents of equal
    source and size get one copy more is decided by the hash of their ids;
    repeated rows are documents of their own. An empty table gives no rows;
    other columns are not read.
    """
    out = _dealt(docs, id_col, text_col, source_col, params)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, params: MixParams) -> DataFrame:
    """A row per document: id, src, tag (a hash of the text), size, source_size, target, copies."""
    p, scratch = params, Scratch(docs.sparkSession)
    src = _source_key(F.col(source_col))
    rows = scratch.stage(
        docs.select(
            F.col(id_col).alias("id"), src.alias("src"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tag")
        ),
        "mix-sizes",
    )
    cells = scratch.stage(rows.groupBy("src", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sources = scratch.stage(targets(cells, p), "mix-targets")
    solved = solve(scratch, cells, sources, p)
    share = scratch.stage(whole_copies(cells, solved, p), "mix-copies")

    share = share.select(
        "src", "size", F.floor(F.col("copies") / F.col("n")).cast("long").alias("base"), (F.col("copies") % F.col("n")).alias("extra"),
        F.ceil(F.col("n") / p.bucket_rows).alias("buckets"),
    )
    share = scratch.stage(share.join(sized(sources.select("src", "source_size", "target")), "src"), "mix-shares")
    at = F.pmod(F.xxhash64("id"), F.col("buckets"))
    dealt = scratch.stage(rows.join(sized(share), ["src", "size"]).withColumn("bucket", F.when(F.col("extra") > 0, at)), "mix-dealt")
    scratch.drop([rows, cells, sources, solved, share])  # the result reads the others
    per = dealt.where("extra > 0").groupBy("src", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(W.partitionBy("src", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = scratch.stage(per.select("src", "size", "bucket", F.coalesce(before, F.lit(0)).alias("before")), "mix-starts")
    rank = F.row_number().over(W.partitionBy("src", "size", "bucket").orderBy(F.xxhash64("id"), "id"))
    ranked = dealt.where("extra > 0").join(sized(starts), ["src", "size", "bucket"]).withColumn("more", (F.col("before") + rank <= F.col("extra")).cast("long"))
    even = dealt.where("extra = 0").withColumn("more", F.lit(0).cast("long"))
    columns = ["id", "src", "tag", "size", "source_size", "target", "base", "more"]
    return ranked.select(columns).unionByName(even.select(columns)).withColumn("copies", F.col("base") + F.col("more"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """The documents the mix takes, with all their columns, ``mix_copies`` and ``mix_taken``.

    Columns of these two names that ``docs`` has are replaced. Rows that repeat
    id, source and text come as one row with the copies of all of them; rows that
    share an id only have copies of their own. Rows without an id take part once
    each. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("mix_copies", "mix_taken")
    keys = ["id", "src", "size", "tag"]
    plan = _dealt(docs, id_col, text_col, source_col, params).where("id is not null").groupBy(*keys)
    plan = plan.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    plan = scratch.stage(plan.select(*[F.col(c).alias(f"__mix_{c}") for c in (*keys, "copies", "rows")]), "mix-plan")
    own = dict(zip(keys, (F.col(id_col), _source_key(F.col(source_col)), word_count(F.col(text_col)), F.xxhash64(text_col))))
    kept = docs.join(sized(plan), [F.col(f"__mix_{k}") == c for k, c in own.items()])
    once = kept.where("__mix_rows > 1").dropDuplicates([f"__mix_{k}" for k in keys])
    kept = kept.where("__mix_rows = 1").unionByName(once)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    copies = F.col("__mix_copies")
    kept = kept.select(*columns, copies.alias("mix_copies"), (copies * F.col("__mix_size")).alias("mix_taken"))
    nameless = docs.where(F.col(id_col).isNull()).select(*columns, F.lit(1).cast("long").alias("mix_copies"), word_count(F.col(text_col)).cast("long").alias("mix_taken"))
    return kept.unionByName(nameless)
