"""Cohort metrics.

Each metric is joins plus grouped aggregation. Group results are small (one
row per group), and every aggregation is partial + final, so a group holding
a third of the population costs the same as any other: the map side reduces
it to one partial row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions._cols import as_col, as_list
from churnscope.functions.numeric import day_number, packed_order, rounded_fraction, rounded_percent, whole_units


def _population(
    population: DataFrame,
    dim: DataFrame | None,
    dim_on: tuple[str, str] | None,
    dim_how: str,
    where: Column | None,
) -> DataFrame:
    """Optional filter, then the optional dimension join (``dim_on`` = (population
    column, dimension column), which may have the same name: the result then
    has it once). An inner join drops keys missing from the dimension;
    ``dim_how='left_semi'`` uses the dimension only as a filter."""
    if where is not None:
        population = population.where(where)
    if dim is None:
        return population
    fk, pk = dim_on if dim_on is not None else (None, None)
    if fk is None:
        raise ValueError("dim_on=(population_column, dimension_column) is required with dim")
    if fk == pk:
        return population.join(dim, fk, dim_how)
    return population.join(dim, population[fk] == dim[pk], dim_how)


def _hit_keys(events: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL event keys.

    Reducing the events to one row per entity first means an entity with
    several events is counted once and cannot inflate the population count
    of a left join. The aggregation leaves the result hash-partitioned on the
    key, which the following join on that key reuses.
    """
    return events.select(F.col(key).alias("__hit")).where(F.col("__hit").isNotNull()).distinct()


def rate_by_group(
    population: DataFrame,
    events: DataFrame,
    on: str,
    by: str | Sequence[str],
    *,
    event_on: str | None = None,
    dim: DataFrame | None = None,
    dim_on: tuple[str, str] | None = None,
    dim_how: str = "inner",
    where: Column | None = None,
    total: str = "total",
    hits: str = "hits",
    rate: str = "rate",
    digits: int = 2,
) -> DataFrame:
    """Event rate per group.

    ``population`` has one row per entity (id ``on``, not NULL) and carries
    the group columns ``by``, or gets them from ``dim``. total = entities per
    group, hits = entities with at least one event, rate = ROUND(hits /
    total * 100, digits) with ties away from zero and NULL instead of a
    division error.
    """
    population = _population(population, dim, dim_on, dim_how, where)
    hit = _hit_keys(events, event_on or on)
    joined = population.join(hit, population[on] == hit["__hit"], "left")
    return rate_of(joined, by, F.col("__hit").isNotNull(), entity=on, total=total, hits=hits, rate=rate, digits=digits)


def rate_of(
    df: DataFrame, by: str | Sequence[str], hit: Column, *, entity: str | None = None,
    total: str = "total", hits: str = "hits", rate: str = "rate", digits: int = 2,
) -> DataFrame:
    """Rate of rows where ``hit`` holds, per group, from one row per entity."""
    counted = F.count(entity) if entity else F.count(F.lit(1))
    return (
        df.groupBy(*as_list(by))
        .agg(counted.alias(total), F.count_if(hit).alias(hits))
        .withColumn(rate, rounded_percent(hits, total, digits))
    )


def split_rate_by_group(
    population: DataFrame,
    events: DataFrame,
    on: str,
    by: str | Sequence[str],
    split: str,
    *,
    event_on: str | None = None,
    dim: DataFrame | None = None,
    dim_on: tuple[str, str] | None = None,
    dim_how: str = "inner",
    where: Column | None = None,
    total: str = "total",
    hits: str = "hits",
    rate: str = "rate",
    digits: int = 2,
) -> DataFrame:
    """Event rate per group and event type over a fixed denominator.

    The denominator is the group's whole population, so each type's rate is
    entities with an event of that type / everyone in the group. A group
    with no event of a type has no row for it. An entity counts once per
    type.

    One pass over the population: events are reduced to one row per entity
    holding the sorted set of its event types (bounded by the number of
    types), which the population left-joins one to one; see ``split_rate_of``.
    """
    population = _population(population, dim, dim_on, dim_how, where)
    key = event_on or on
    types = (
        events.where(F.col(key).isNotNull() & F.col(split).isNotNull())
        .groupBy(F.col(key).alias("__hit"))
        .agg(F.array_sort(F.collect_set(split)).alias("__types"))
    )
    joined = population.join(types, population[on] == types["__hit"], "left")
    return split_rate_of(joined, by, "__types", split, entity=on, total=total, hits=hits, rate=rate, digits=digits)


def split_rate_of(
    df: DataFrame, by: str | Sequence[str], types: str, split: str, *, entity: str | None = None,
    total: str = "total", hits: str = "hits", rate: str = "rate", digits: int = 2,
) -> DataFrame:
    """Rate of each type in the array column ``types`` per group, from one row per entity.

    ``posexplode_outer`` gives a row per (entity, type); one aggregation by
    (group, type) counts entities and first rows, and a window over those few
    rows per group sums the first rows to the group's total.
    """
    keys = as_list(by)
    here = F.col(entity).isNotNull() if entity else F.lit(True)
    rows = df.select(*keys, here.alias("__here"), F.posexplode_outer(types).alias("__pos", "__type"))
    first_row = (F.col("__pos") == 0) | F.col("__pos").isNull()
    counted = rows.groupBy(*keys, "__type").agg(
        F.count_if("__here").alias("__hits"), F.count_if(F.col("__here") & first_row).alias("__first")
    )
    return (
        counted.withColumn(total, F.sum("__first").over(Window.partitionBy(*keys)))
        .where(F.col("__type").isNotNull())
        .select(
            *keys,
            total,
            F.col("__type").alias(split),
            F.col("__hits").alias(hits),
            rounded_percent("__hits", total, digits).alias(rate),
        )
    )


def latest_per_key(
    df: DataFrame, key: str | Sequence[str], order_by: Sequence[Column | str]
) -> DataFrame:
    """The first row per key under ``order_by`` (W17), e.g. latest date, then highest id.

    ``row_number() = 1`` is planned as WindowGroupLimit partial + final: each
    map task keeps one row per key before the shuffle, so hot keys stay cheap.
    Make ``order_by`` total for a deterministic result.
    """
    w = Window.partitionBy(*as_list(key)).orderBy(*[as_col(c) for c in order_by])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def latest_by_date(df: DataFrame, key: str | Sequence[str], date: str, id: str) -> DataFrame:
    """The row of the latest ``date`` per key, ties by the highest ``id`` (W17), without a sort.

    The same row as ``latest_per_key`` with both descending (a NULL date is
    earlier than any). Date and id are packed into one fixed-width number, and
    every other column is a ``max_by`` on it, so where these columns have a
    fixed width too (numbers, dates, booleans) the whole thing is one partial +
    final hash aggregation: no map task sorts its rows, and a hot key leaves it as
    one row. ``id`` is unique within a key. Text columns are right as well, but
    make Spark aggregate by sorting; prefer to look them up by ``id`` afterwards.
    """
    keys = as_list(key)
    order = packed_order(date, df.schema[date].dataType, id)
    rest = [c for c in df.columns if c not in keys]
    agg = df.withColumn("__order", order).groupBy(*keys).agg(*[F.max_by(c, "__order").alias(c) for c in rest])
    return agg.select(*df.columns)


def group_gap(
    df: DataFrame,
    by: str | Sequence[str],
    measure: str,
    flag: str,
    a,
    b,
    *,
    names: tuple[str, str, str] = ("avg_a", "avg_b", "gap"),
    digits: int = 2,
) -> DataFrame:
    """Per group: mean measure where flag = a, where flag = b, and their
    difference (W18). The gap is that of the exact means; each output is
    rounded once, from exact sums in whole units (cents). A side with no rows
    gives NULL mean and NULL gap. One pass, no pivot."""
    keys = as_list(by)
    units, per_one = whole_units(measure, df.schema[measure].dataType)
    sides = {s: F.when(F.col(flag) == F.lit(v), units) for s, v in (("a", a), ("b", b))}
    agg = df.groupBy(*keys).agg(
        *[F.sum(m).cast("decimal(38,0)").alias(f"__s{s}") for s, m in sides.items()],
        *[F.count(m).alias(f"__n{s}") for s, m in sides.items()],
    )
    n_a, n_b, n_gap = names
    c = {k: F.col(k).cast("decimal(38,0)") for k in ("__sa", "__sb", "__na", "__nb")}
    one = F.lit(per_one)
    return agg.select(
        *keys,
        rounded_fraction(c["__sa"], c["__na"] * one, digits).alias(n_a),
        rounded_fraction(c["__sb"], c["__nb"] * one, digits).alias(n_b),
        # Sa / na - Sb / nb as one fraction.
        rounded_fraction(c["__sa"] * c["__nb"] - c["__sb"] * c["__na"], c["__na"] * c["__nb"] * one, digits).alias(n_gap),
    )


def mean_elapsed_by_group(
    population: DataFrame,
    events: DataFrame,
    on: str,
    by: str | Sequence[str],
    start: str,
    end: str,
    *,
    event_on: str | None = None,
    dim: DataFrame | None = None,
    dim_on: tuple[str, str] | None = None,
    dim_how: str = "inner",
    where: Column | None = None,
    unit_days: int = 365,
    name: str = "mean_years",
    digits: int = 2,
) -> DataFrame:
    """Mean whole-day span from ``start`` (population) to ``end`` (events),
    in units of ``unit_days``, per group (W19). Entities without an event are
    left out (inner join); every event row counts.

    Events are first reduced to one row per entity: the number of dated
    events and the sum of their day numbers. Since the span of each event is
    ``end_day - start_day``, an entity's total is ``sum_end - n * start_day``:
    exact integers, so the join is one-to-one (an entity with a third of all
    events is one row after the map-side partial aggregation) and the mean
    is sum(days) / (count * unit_days) with a single division.
    """
    population = _population(population, dim, dim_on, dim_how, where)
    end_day = day_number(end)
    # Undated events still make the entity join (as in a plain inner join)
    # but add no span: __k counts dated events only.
    per_entity = events.groupBy(F.col(event_on or on).alias("__eid")).agg(
        F.count(end_day).alias("__k"), F.sum(end_day).alias("__end_sum")
    )
    joined = population.join(per_entity, population[on] == per_entity["__eid"], "inner")
    start_day = day_number(start)
    days = F.col("__end_sum") - F.col("__k") * start_day
    spans = F.when(start_day.isNotNull(), F.col("__k"))
    return mean_elapsed_of(joined, by, days, spans, unit_days=unit_days, name=name, digits=digits)


def mean_elapsed_of(
    df: DataFrame, by: str | Sequence[str], days: Column, spans: Column, *,
    unit_days: int = 365, name: str = "mean_years", digits: int = 2,
) -> DataFrame:
    """sum(days) / (sum(spans) * unit_days) per group, rounded exactly."""
    keys = as_list(by)
    agg = df.groupBy(*keys).agg(F.sum(days).alias("__s"), F.sum(spans).alias("__n"))
    return agg.select(*keys, rounded_fraction("__s", F.col("__n") * F.lit(unit_days), digits).alias(name))
