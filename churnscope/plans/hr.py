"""The original project's flow on tables in its own HR layout.

Given ``employees``, ``departments``, ``salary_history`` and ``attrition``
(see ``churnscope.sources.hr``), ``hr_report`` returns every result of the
original audit, cleaning-verification and analysis scripts as a lazy
DataFrame, with the original output column names, so a user of the
original SQL gets the same tables from Spark. Underneath it is the generic
role-based plan of ``churnscope.plans.cohort``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from churnscope.functions.text import BINARY, CASE_INSENSITIVE, text_key
from churnscope.operators import audit
from churnscope.operators.quality import quality_report
from churnscope.plans import cohort, report, staging
from churnscope.sources import hr


def hr_inputs(tables: dict[str, DataFrame]) -> cohort.CohortInputs:
    return cohort.CohortInputs(
        people=hr.as_roles("employees", tables["employees"]),
        units=hr.as_roles("departments", tables["departments"]),
        exits=hr.as_roles("attrition", tables["attrition"]),
        measures=hr.as_roles("salary_history", tables["salary_history"]),
    )


def _rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def employees_clean(i: cohort.CohortInputs, collation: str = BINARY) -> DataFrame:
    """The ``employees_clean`` view."""
    return _clean_names(cohort.clean_people(i.people, i.units, natural_key=hr.NATURAL_KEY, collation=collation))


def salary_clean(i: cohort.CohortInputs) -> DataFrame:
    """The ``salary_clean`` view."""
    return _salary_names(cohort.clean_measures(i.measures))


def _salary_names(measures: DataFrame) -> DataFrame:
    return _rename(measures, {v: k for k, v in hr.ROLE_NAMES["salary_history"].items()})


def _clean_names(clean: DataFrame) -> DataFrame:
    back = {v: k for k, v in hr.ROLE_NAMES["employees"].items()}
    back.update(clean_role="clean_job_role", clean_unit_id="clean_department_id")
    return _rename(clean, back)


def _with_status(clean: DataFrame, collation: str) -> DataFrame:
    """Statuses in their listed spelling, so that flags compare as ``collation`` says."""
    if collation == BINARY:
        return clean
    status = F.lower("status")
    listed = [F.when(status == s.lower(), s) for s in (cohort.ACTIVE, cohort.TERMINATED)]
    return clean.withColumn("status", F.coalesce(*listed, F.col("status")))


# Verification labels of the original queries.
CHECK_NAMES = {
    "raw_people": "raw_employees", "clean_people": "clean_employees", "remaining_bad_units": "remaining_bad_depts",
    "raw_measures": "raw_salary_rows", "clean_measures": "clean_salary_rows",
}


class CleanViews:
    """The raw tables and the two cleaned views by their original names, for ``spark.sql``.

    ``create`` writes each cleaned view once to the checkpoint folder, so any number
    of statements share one deduplication and key recovery, and counts the rows as
    they are written; ``drop`` removes the names and the files. Both may
    be repeated: creating again replaces what is there, as DROP VIEW IF EXISTS and CREATE
    VIEW do. As a context manager the views live as long as the block::

        with CleanViews(tables) as views:
            views.sql("SELECT count(*) FROM employees_clean").show()

    ``staged=False`` keeps lazy views, which each statement computes anew and which count nothing.
    """

    NAMES = ("employees_clean", "salary_clean")

    def __init__(self, tables: dict[str, DataFrame], collation: str = BINARY, staged: bool = True):
        self.tables, self.collation, self.staged = tables, collation, staged
        self.spark = tables["employees"].sparkSession
        self.inputs = hr_inputs(tables)
        self.frames: dict[str, DataFrame] = {}
        #: Rows counted while the views were written, by verification label.
        self.counts: dict[str, int] = {}

    def create(self) -> CleanViews:
        self.drop()
        i = self.inputs
        clean = cohort.clean_people(i.people, i.units, natural_key=hr.NATURAL_KEY, collation=self.collation)
        measures = i.measures
        if self.staged:
            clean = staging.stage(clean, "employees_clean", counts=cohort.clean_counts())
            seen, one = Observation(), F.count(F.lit(1))
            # The raw rows and, behind the filter, the clean ones: one pass that only reads and writes.
            measures = cohort.clean_measures(measures.observe(seen, one.alias("raw_measures")))
            measures = staging.stage(measures, "salary_clean", counts={"clean_measures": one})
            found = {**staging.staged_counts(clean), **staging.staged_counts(measures), **seen.get}
            self.counts = {CHECK_NAMES[k]: n for k, n in found.items()}
            self._files = (clean, measures)
        else:
            measures = cohort.clean_measures(measures)
        self.frames = dict(zip(self.NAMES, (_clean_names(clean), _salary_names(measures))))
        for name, df in {**self.tables, **self.frames}.items():
            df.createOrReplaceTempView(name)
        return self

    def sql(self, statement: str) -> DataFrame:
        return self.spark.sql(statement)

    def verification(self, given: dict[str, int] | None = None) -> DataFrame:
        """The verification block: the counts of the written views against what the raw tables say."""
        i = self.inputs
        people = {
            "clean_people": cohort.distinct_people(i.people, hr.NATURAL_KEY, self.collation),
            "remaining_bad_units": F.lit(0) * F.count(F.lit(1)),
        }
        if not self.counts:
            raise RuntimeError("create staged views first: the counts are taken while they are written")
        own = {v: k for k, v in CHECK_NAMES.items()}
        out = quality_report(
            actual=[(i.people, {"raw_people": F.count(F.lit(1))})],
            expected=[(i.people, people), (i.measures, {"clean_measures": F.count(F.lit(1)) - F.count_if(cohort.bad_measure("amount"))})],
            counted={own[k]: n for k, n in self.counts.items()},
            given={own[k]: n for k, n in (given or {}).items() if k in own},
        )
        return out.replace(CHECK_NAMES, subset=["check_name"])

    def drop(self) -> None:
        if self.frames:
            for name in (*self.tables, *self.frames):
                self.spark.catalog.dropTempView(name)
            staging.unstage(*self._files)
        self.frames, self.counts, self._files = {}, {}, ()

    _files: tuple[DataFrame, ...] = ()

    def __enter__(self) -> CleanViews:
        return self.create()

    def __exit__(self, *exc) -> None:
        self.drop()


def create_views(tables: dict[str, DataFrame], collation: str = BINARY, staged: bool = True) -> CleanViews:
    """The tables and the two cleaned views under their original names; the result drops them again."""
    return CleanViews(tables, collation, staged).create()


def hr_report(
    tables: dict[str, DataFrame], staged: bool = False, collation: str = BINARY, given: dict[str, int] | None = None
) -> dict[str, DataFrame]:
    """Every result by name. With ``staged`` the cleaned people and one row of facts
    per person are written once to the checkpoint folder and all later results
    read them; ``staging.staged_files`` deletes them when the results are written.

    ``collation``: whether names and flags that differ only in case are equal
    (MySQL's usual default) or not. ``given``: expected counts by verification
    label.
    """
    i = hr_inputs(tables)
    emp, dept = tables["employees"], tables["departments"]
    sal, att = tables["salary_history"], tables["attrition"]
    # Binary: compared as they are.
    flag = lambda df, c, v: text_key(df, c, collation) == F.lit(v if collation == BINARY else v.lower())
    clean = cohort.clean_people(i.people, i.units, natural_key=hr.NATURAL_KEY, collation=collation)
    keep = staging.stage if staged else (lambda df, name: df)
    clean = keep(clean, "employees_clean")
    facts = keep(report.person_facts(_with_status(clean, collation), i.units, i.exits, i.measures), "hr_facts")
    metric = report.metrics_from_facts(facts)
    clean_view = _clean_names(clean)

    # Output column names of the original queries.
    rate_names = {"unit_name": "department_name", "total": "total_employees",
                  "leavers": "total_leavers", "rate": "attrition_rate"}
    return {
        # --- audit
        "row_counts": audit.row_counts(
            {"employees": emp, "salary_history": sal, "attrition": att}
        ),
        "employee_preview": audit.preview(emp, 10, F.col("employee_id").asc_nulls_first()),
        "distinct_job_roles": audit.distinct_values(emp, "job_role"),
        "distinct_department_ids": audit.distinct_values(emp, "department_id"),
        "departments": audit.preview(dept, None),
        "distinct_performance_ratings": audit.distinct_values(emp, "performance_rating"),
        "orphan_department_ids": audit.orphan_keys(emp, dept, "department_id"),
        "bad_salary_rows": audit.invalid_measure_count(sal, "salary_amount", "bad_salary_rows"),
        "terminated_missing_from_attrition": audit.missing_match_count(
            emp, att, "employee_id", where=flag(emp, "employment_status", cohort.TERMINATED),
            name="terminated_missing_from_attrition",
        ),
        "duplicate_employees": audit.duplicate_groups(
            emp, ["first_name", "last_name", "hire_date"], collation=collation
        ),
        "null_id_rows": audit.null_key_rows(emp, "employee_id"),
        "role_department_violations": audit.fd_violations(
            emp, "job_role", "department_id", dept,
            determinant_name="clean_role", count="dept_count",
        ),
        # --- cleaning and its verification
        "employees_clean": clean_view,
        "salary_clean": salary_clean(i),
        "verification": cohort.quality(
            i.people, clean, i.measures, natural_key=hr.NATURAL_KEY, collation=collation,
            given={k: (given or {})[v] for k, v in CHECK_NAMES.items() if v in (given or {})},
        ).replace(CHECK_NAMES, subset=["check_name"]),
        "distinct_clean_job_roles": audit.distinct_values(clean_view, "clean_job_role"),
        # --- the five questions
        "attrition_by_department": _rename(metric["rate_by_group"], rate_names),
        "attrition_by_department_and_type": _rename(metric["split_rate_by_group"], rate_names),
        "attrition_by_performance": _rename(
            metric["rate_by_rating"], dict(rate_names, rating="performance_rating")
        ),
        "salary_gap_by_role": _rename(
            metric["salary_gap"],
            {"clean_role": "clean_job_role", "avg_stayers": "avg_salary_stayers",
             "avg_leavers": "avg_salary_leavers", "gap": "salary_gap"},
        ),
        "tenure_before_exit": _rename(
            metric["mean_elapsed_by_group"],
            {"unit_name": "department_name", "mean_years": "avg_tenure_years"},
        ),
    }


def write_report(results: dict[str, DataFrame], out: str, fmt: str = "parquet", **options) -> None:
    """Write every result under ``out/<name>`` (one job per result, no driver collection)."""
    for name, df in results.items():
        df.write.mode("overwrite").format(fmt).options(**options).save(f"{out.rstrip('/')}/{name}")


def _expected(pairs: list[str]) -> dict[str, int]:
    known, out = set(CHECK_NAMES.values()), {}
    for pair in pairs:
        name, _, count = pair.partition("=")
        if name not in known or not count.isdigit():
            raise SystemExit(f"--expect {pair}: use one of {', '.join(sorted(known))} and a count, as raw_employees=761")
        out[name] = int(count)
    return out


def main(argv: list[str] | None = None) -> None:
    """``python -m churnscope.plans.hr --input DIR [--format csv] --output DIR``

    Writes every result of ``hr_report``, and the result of each ``--sql`` file (one SELECT on the
    tables and the views ``employees_clean`` and ``salary_clean``) under the file's name.
    """
    import argparse

    from churnscope.session import build_session

    ap = argparse.ArgumentParser(description="Run the original audit, cleaning and analysis on HR tables.")
    ap.add_argument("--input", required=True, help="folder with employees, departments, ... tables")
    ap.add_argument("--format", default="parquet", help="input file format (parquet, csv, json, orc)")
    ap.add_argument("--output", required=True, help="folder for the results, one sub-folder each")
    ap.add_argument("--output-format", default="parquet")
    ap.add_argument("--master", default=None, help="Spark master when run outside spark-submit")
    ap.add_argument("--collation", default=BINARY, choices=[BINARY, CASE_INSENSITIVE], help="whether names that differ in case are equal")
    ap.add_argument("--expect", action="append", default=[], metavar="CHECK=COUNT", help="expected count of the verification, as raw_employees=761")
    ap.add_argument("--sql", action="append", default=[], metavar="FILE", help="a SELECT on the tables and the cleaned views")
    args = ap.parse_args(argv)
    given = _expected(args.expect)
    # Without --master, the launcher (spark-submit) decides master and partitions.
    spark = build_session(master=args.master, shuffle_partitions=None)
    opts = {"header": "true"} if args.format == "csv" else {}
    out_opts = {"header": "true"} if args.output_format == "csv" else {}
    # Cleaned people are staged where the session names a shared folder, else next to the results.
    staging.ensure_checkpoint_dir(spark, f"{args.output.rstrip('/')}/_staging")
    tables = hr.read_hr_tables(spark, args.input, args.format, **opts)
    with staging.staged_files():
        results = hr_report(tables, staged=True, collation=args.collation, given=given)
        write_report(results, args.output, args.output_format, **out_opts)
    if args.sql:
        with CleanViews(tables, args.collation) as views:
            asked = {Path(f).stem: views.sql(Path(f).read_text().strip().rstrip(";")) for f in args.sql}
            write_report(asked, args.output, args.output_format, **out_opts)


if __name__ == "__main__":
    main()
