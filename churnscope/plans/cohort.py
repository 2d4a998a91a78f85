"""The audit -> clean -> metrics flow on the four input roles.

Column names are those of ``churnscope.sources.bindings``. Each function
returns a lazy DataFrame; nothing runs until the caller acts on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions.text import BINARY, normalize_text, text_key
from churnscope.operators import cleaning, metrics
from churnscope.operators.quality import quality_report
from churnscope.plans import staging
from churnscope.sources import bindings
from churnscope.sources.tables import TableReader

# The only unit key treated as a placeholder for "unknown".
SENTINEL_UNITS = (99,)
NATURAL_KEY = ("person_name", "start_ts")
ACTIVE, TERMINATED = bindings.ACTIVE, bindings.TERMINATED


def clean_columns(people_columns: list[str]) -> list[str]:
    """Output columns of ``clean_people``: every entity column, with
    ``role_raw`` replaced in place by ``clean_role``, ``unit_id`` dropped and
    ``clean_unit_id`` appended (the raw role and key stay in the raw table)."""
    cols = ["clean_role" if c == "role_raw" else c for c in people_columns if c != "unit_id"]
    return cols + ["clean_unit_id"]


_ROLE_BUILDERS = {
    "people": bindings.people,
    "units": bindings.units,
    "exits": bindings.exits,
    "measures": bindings.measures,
}


class CohortInputs:
    """The four input roles: given directly, or derived from the driver
    tables on first use (a query that needs only the units never builds the
    people binding).

    ``measured_people`` are the people with ``latest_amount``, the amount of their
    latest valid measure (NULL: none). From the driver tables it comes out of the
    aggregation of the orders that the people need anyway, so the measures
    are neither read nor shuffled for it.
    """

    def __init__(
        self,
        people: DataFrame | None = None,
        units: DataFrame | None = None,
        exits: DataFrame | None = None,
        measures: DataFrame | None = None,
    ):
        self._roles = {"people": people, "units": units, "exits": exits, "measures": measures}
        self._tables: TableReader | None = None
        self._staged = False
        self._history: DataFrame | None = None

    @classmethod
    def from_tables(cls, tables: TableReader, staged: bool = False) -> CohortInputs:
        """``staged``: write the history of each customer and the people once to the
        checkpoint folder, and read every role but the measures from there: one scan of
        the orders and one of the customers, however many results are made of them."""
        inputs = cls()
        inputs._tables = tables
        inputs._staged = staged
        return inputs

    @property
    def history(self) -> DataFrame | None:
        """The staged history of each customer, with the counts of all measures."""
        if self._history is None and self._staged:
            sums = {c: F.sum(c) for c in ("n_measures", "n_valid", "n_bad")}
            self._history = staging.stage(bindings.order_history(self._tables), "history", counts=sums)
        return self._history

    def _role(self, name: str) -> DataFrame:
        if self._roles[name] is None and self._tables is not None:
            if self._staged and name == "people":
                people = bindings.people(self._tables, measured=True, history=self.history)
                self._roles[name] = staging.stage(people, "people", counts={"raw_people": F.count(F.lit(1))})
            elif self._staged and name == "exits":
                self._roles[name] = bindings.exits(self._tables, self.history)
            else:
                self._roles[name] = _ROLE_BUILDERS[name](self._tables)
        return self._roles[name]

    people = property(lambda self: self._role("people"))
    units = property(lambda self: self._role("units"))
    exits = property(lambda self: self._role("exits"))
    measures = property(lambda self: self._role("measures"))

    @property
    def measured_people(self) -> DataFrame:
        if self._staged:
            return self.people
        if self._tables is not None:
            return bindings.people(self._tables, measured=True)
        return with_latest(self.people, self.measures)


# ---------------------------------------------------------------- cleaning


def dedup_people(people: DataFrame, natural_key=NATURAL_KEY, collation: str = BINARY) -> DataFrame:
    """Drop the NULL-id row, then keep the lowest id per natural key."""
    return cleaning.dedup_keep_first(people, natural_key, ["person_id"], require="person_id", collation=collation)


def clean_people(
    people: DataFrame,
    units: DataFrame,
    sentinels=SENTINEL_UNITS,
    valid_only: bool = False,
    natural_key=NATURAL_KEY,
    rows_per_salt: int = 1_000_000,
    collation: str = BINARY,
) -> DataFrame:
    """Deduplicated people with a normalised role and a recovered unit key.

    The recovery evidence is the *raw* table (rows later dropped as
    duplicates still tell which unit a role belongs to). Columns other than
    the roles' (names, gender, age, ...) are carried through.
    """
    deduped = dedup_people(people, natural_key, collation)
    imputed = cleaning.impute_key_by_fd(
        deduped,
        key="unit_id",
        determinant="role_raw",
        dim=units,
        source=people,
        sentinels=sentinels,
        valid_only=valid_only,
        output="clean_unit_id",
        salt_by="person_id",
        rows_per_salt=rows_per_salt,
    )
    return imputed.withColumn("clean_role", normalize_text("role_raw")).select(
        *clean_columns(people.columns)
    )


def clean_measures(measures: DataFrame) -> DataFrame:
    return cleaning.valid_measures(measures, "amount").select(
        "measure_id", "person_id", "amount", "effective_ts"
    )


def latest_measure(measures: DataFrame) -> DataFrame:
    """Latest valid measure per person; a tie on the date goes to the higher id."""
    return metrics.latest_by_date(clean_measures(measures), "person_id", "effective_ts", "measure_id")


def with_latest(people: DataFrame, measures: DataFrame) -> DataFrame:
    """``people`` with the amount of their latest valid measure, NULL without one."""
    latest = latest_measure(measures).select("person_id", F.col("amount").alias("latest_amount"))
    return people.join(latest, "person_id", "left")


# People join their unit on the recovered key; the inner join drops
# unrecoverable keys.
UNIT_ON = ("clean_unit_id", "unit_id")


# ---------------------------------------------------------------- metrics


def attrition_by_unit(clean: DataFrame, units: DataFrame, exits: DataFrame) -> DataFrame:
    """Q1: leavers / headcount per unit, highest rate first.

    Grouped by unit id and name, shown by name, so two units sharing a name
    stay two rows.
    """
    out = metrics.rate_by_group(
        clean, exits, "person_id", ["unit_id", "unit_name"], dim=units, dim_on=UNIT_ON,
        total="total", hits="leavers", rate="rate",
    )
    return out.orderBy(F.desc("rate"), "unit_name", "unit_id").select(
        "unit_name", "total", "leavers", "rate"
    )


def attrition_by_unit_and_type(clean: DataFrame, units: DataFrame, exits: DataFrame) -> DataFrame:
    """Q2: leavers of each exit type / the unit's whole headcount."""
    out = metrics.split_rate_by_group(
        clean, exits, "person_id", ["unit_id", "unit_name"], "exit_type",
        dim=units, dim_on=UNIT_ON, total="total", hits="leavers", rate="rate",
    )
    return out.orderBy("unit_name", "exit_type", "unit_id").select(
        "unit_name", "total", "exit_type", "leavers", "rate"
    )


def attrition_by_rating(clean: DataFrame, units: DataFrame, exits: DataFrame) -> DataFrame:
    """Q3: rate per performance rating; unrated people and people without a
    valid unit are left out (the unit join acts only as a filter)."""
    out = metrics.rate_by_group(
        clean, exits, "person_id", ["rating"],
        dim=units, dim_on=UNIT_ON, dim_how="left_semi", where=F.col("rating").isNotNull(),
        total="total", hits="leavers", rate="rate",
    )
    return out.orderBy(F.desc("rate"), "rating")


def measure_gap_by_role(clean: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """Q4: mean latest measure of stayers vs leavers per role, and the gap.

    Leaver here means status 'Terminated' (not an exit row). No unit join:
    people whose unit is unrecoverable stay in. Without ``measures``, ``clean``
    (made of ``measured_people``) has ``latest_amount``, and nothing is joined.
    """
    if measures is not None:
        clean = with_latest(clean.drop("latest_amount"), measures)
    out = metrics.group_gap(
        clean.where(F.col("latest_amount").isNotNull()), "clean_role", "latest_amount", "status", ACTIVE, TERMINATED,
        names=("avg_stayers", "avg_leavers", "gap"),
    )
    return out.orderBy(F.asc_nulls_first("gap"), "clean_role")


def tenure_before_exit_by_unit(clean: DataFrame, units: DataFrame, exits: DataFrame) -> DataFrame:
    """Q5: mean years from start to exit per unit, leavers only, shortest first."""
    out = metrics.mean_elapsed_by_group(
        clean, exits, "person_id", ["unit_id", "unit_name"], "start_ts", "exit_ts",
        dim=units, dim_on=UNIT_ON, name="mean_years",
    )
    return out.orderBy(F.asc_nulls_first("mean_years"), "unit_name", "unit_id").select(
        "unit_name", "mean_years"
    )


# ---------------------------------------------------------------- quality


def quality(
    people: DataFrame,
    clean: DataFrame,
    measures: DataFrame,
    clean_measure_rows: DataFrame | None = None,
    sentinels=SENTINEL_UNITS,
    natural_key=NATURAL_KEY,
    collation: str = BINARY,
    given: dict[str, int] | None = None,
) -> DataFrame:
    """The verification block after cleaning; each table it is given is read once.

    The cleaned tables are counted (``clean``, ``clean_measure_rows``, by
    default the rows that this module's ``clean_measures`` keeps) and held against
    what the raw tables say: one person per natural key of the rows with an id, and the
    measures that are present and positive. ``given``: counts known beforehand.
    """
    one = F.lit(1)
    found: dict[str, Column] = {"raw_measures": F.count(one)}
    views = []
    if clean_measure_rows is None:
        found["clean_measures"] = F.count_if(cleaning.valid_measure("amount"))
    else:
        views.append((clean_measure_rows, {"clean_measures": F.count(one)}))
    return quality_report(
        actual=[(people, {"raw_people": F.count(one)}), (clean, clean_counts(sentinels)), (measures, found), *views],
        expected=[
            (people, {"clean_people": distinct_people(people, natural_key, collation), "remaining_bad_units": F.lit(0) * F.count(one)}),
            (measures, {"clean_measures": F.count(one) - F.count_if(bad_measure("amount"))}),
        ],
        given=given,
    )


def bad_measure(column: str) -> Column:
    """The check's own definition, not the view's: NULL, zero or negative."""
    return F.col(column).isNull() | (F.col(column) <= 0)


def clean_counts(sentinels=SENTINEL_UNITS) -> dict[str, Column]:
    """What is counted of the cleaned people."""
    unit = F.col("clean_unit_id")
    return {"clean_people": F.count(F.lit(1)), "remaining_bad_units": F.count_if(unit.isNull() | unit.isin(*sentinels))}


def distinct_people(people: DataFrame, natural_key=NATURAL_KEY, collation: str = BINARY) -> Column:
    """Number of natural keys among the rows with an id."""
    key = F.struct(*[text_key(people, k, collation).alias(k) for k in natural_key])
    return F.count_distinct(F.when(F.col("person_id").isNotNull(), key))


def staged_quality(inputs: CohortInputs, sentinels=SENTINEL_UNITS, natural_key=NATURAL_KEY, collation: str = BINARY) -> DataFrame:
    """The verification block on inputs ``from_tables(..., staged=True)``.

    One scan of each raw table: the measures are counted while the history of
    each customer is written (once by the check's definition, once by the
    view's), the raw people while the people are; the cleaned people and the natural keys
    they are held against come from the staged people.
    """
    measured = staging.staged_counts(inputs.history)
    total, valid, bad = (measured[c] or 0 for c in ("n_measures", "n_valid", "n_bad"))
    counted = {**staging.staged_counts(inputs.people), "raw_measures": total, "clean_measures": valid}
    clean = clean_people(inputs.people, inputs.units, sentinels=sentinels, natural_key=natural_key, collation=collation)
    expected = {"clean_people": distinct_people(inputs.people, natural_key, collation), "remaining_bad_units": F.lit(0) * F.count(F.lit(1))}
    return quality_report(
        actual=[(clean, clean_counts(sentinels))], expected=[(inputs.people, expected)],
        counted=counted, given={"clean_measures": total - bad},
    )
