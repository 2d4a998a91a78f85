"""The original HR layout end to end, on a small fixture of our own rows.

Expected values are worked out by hand in the comments.
"""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal as D

import pytest

from churnscope.plans import cohort
from churnscope.plans.hr import CleanViews, create_views, hr_report, main
from churnscope.plans.staging import checkpoint_root
from churnscope.sources.hr import SCHEMAS
from conftest import rows


def d(s):
    return dt.date.fromisoformat(s)


@pytest.fixture
def tables(spark):
    departments = [(1, "Sales"), (2, "Legal"), (3, "Ops")]
    employees = [
        (1, "Ann", "Lee", 1, "Sales Rep", d("2020-01-01"), "F", 30, 5, "Terminated"),
        (2, "Bob", "Kim", 1, "sales rep ", d("2020-02-01"), "M", 40, 3, "Active"),
        (3, "Cy", "Fox", None, "SALES REP", d("2020-03-01"), "M", 35, None, "Active"),
        (4, "Di", "Ray", 99, "Counsel", d("2021-01-01"), "F", 45, 4, "Terminated"),
        (5, "Ed", "Day", 2, "counsel", d("2021-02-01"), "M", 50, 4, "Active"),
        (6, "Flo", "Ng", 3, "Analyst", d("2019-06-01"), "F", 28, 2, "Terminated"),
        (7, "Gus", "Po", 3, "analyst", d("2019-07-01"), "M", 33, 1, "Active"),
        (8, "Ann", "Lee", 1, "SALES REP", d("2020-01-01"), "F", 30, 5, "Terminated"),
        (9, "Hal", "Wu", 99, "Nowhere", d("2022-01-01"), "M", 29, 3, "Active"),
        (None,) * 10,
    ]
    salary = [
        (1, 1, D("50000.00"), d("2020-01-01")),
        (2, 1, D("55000.00"), d("2021-01-01")),
        (3, 2, D("40000.00"), d("2020-02-01")),
        (4, 2, None, d("2022-01-01")),
        (5, 3, D("45000.00"), d("2020-03-01")),
        (6, 4, D("70000.00"), d("2021-01-01")),
        (7, 5, D("60000.00"), d("2021-02-01")),
        (8, 5, D("-1.00"), d("2023-01-01")),
        (9, 6, D("30000.00"), d("2019-06-01")),
        (10, 7, D("0.00"), d("2019-07-01")),
        (11, 8, D("99999.00"), d("2020-01-01")),
        (12, 9, D("20000.00"), d("2022-01-01")),
    ]
    attrition = [
        (1, 1, d("2022-01-01"), "Voluntary", "Pay"),
        (2, 4, d("2023-01-01"), "Involuntary", "Performance"),
        (3, 8, d("2021-06-01"), "Involuntary", "Conduct"),
    ]
    data = {"departments": departments, "employees": employees,
            "salary_history": salary, "attrition": attrition}
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in data.items()}


def test_audit(tables):
    r = hr_report(tables)
    assert rows(r["row_counts"]) == [("attrition", 3), ("employees", 10), ("salary_history", 12)]
    assert r["employee_preview"].count() == 10
    assert r["distinct_job_roles"].count() == 9  # 8 spellings and NULL
    assert [x[0] for x in r["distinct_department_ids"].collect()] == [None, 1, 2, 3, 99]
    assert r["departments"].count() == 3
    assert [x[0] for x in r["distinct_performance_ratings"].collect()] == [None, 1, 2, 3, 4, 5]
    assert rows(r["orphan_department_ids"]) == [(None, "null", 2), (99, "orphan", 2)]
    assert r["bad_salary_rows"].first()[0] == 3  # NULL, -1, 0
    assert r["terminated_missing_from_attrition"].first()[0] == 1  # employee 6
    assert rows(r["duplicate_employees"]) == [("Ann", "Lee", d("2020-01-01"), 2)]
    assert r["null_id_rows"].count() == 1
    assert r["role_department_violations"].count() == 0


def test_cleaning(tables):
    r = hr_report(tables)
    clean = r["employees_clean"]
    assert clean.columns == ["employee_id", "first_name", "last_name", "clean_job_role", "hire_date",
                             "gender", "age", "performance_rating", "employment_status",
                             "clean_department_id"]
    assert rows(clean, "employee_id", "clean_department_id") == [
        (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3), (9, None)]
    assert r["salary_clean"].count() == 9
    checks = {x.check_name: (x.actual, x.expected, x.passed) for x in r["verification"].collect()}
    assert checks == {
        "raw_employees": (10, None, None),
        "clean_employees": (8, 8, True),
        "remaining_bad_depts": (1, 0, False),  # Hal Wu's role exists nowhere else
        "raw_salary_rows": (12, None, None),
        "clean_salary_rows": (9, 9, True),
    }
    assert [x[0] for x in r["distinct_clean_job_roles"].collect()] == [
        "analyst", "counsel", "nowhere", "sales rep"]


def test_five_questions(tables):
    r = hr_report(tables)
    # Sales: Ann, Bob, Cy (recovered); Ann left. Legal: Di (recovered), Ed; Di left.
    # Ops: Flo is terminated without an exit row, so no leaver. Ann's duplicate (8) is gone.
    q1 = r["attrition_by_department"]
    assert q1.columns == ["department_name", "total_employees", "total_leavers", "attrition_rate"]
    assert [tuple(x) for x in q1.collect()] == [
        ("Legal", 2, 1, D("50.00")), ("Sales", 3, 1, D("33.33")), ("Ops", 2, 0, D("0.00"))]
    assert [tuple(x) for x in r["attrition_by_department_and_type"].collect()] == [
        ("Legal", 2, "Involuntary", 1, D("50.00")), ("Sales", 3, "Voluntary", 1, D("33.33"))]
    assert [tuple(x) for x in r["attrition_by_performance"].collect()] == [
        (5, 1, 1, D("100.00")), (4, 2, 1, D("50.00")), (1, 1, 0, D("0.00")),
        (2, 1, 0, D("0.00")), (3, 1, 0, D("0.00"))]
    # Latest valid salaries: Ann 55000 (T), Bob 40000, Cy 45000, Di 70000 (T), Ed 60000,
    # Flo 30000 (T), Gus none valid, Hal 20000.
    assert rows(r["salary_gap_by_role"]) == [
        ("analyst", None, D("30000.00"), None),
        ("counsel", D("60000.00"), D("70000.00"), D("-10000.00")),
        ("nowhere", D("20000.00"), None, None),
        ("sales rep", D("42500.00"), D("55000.00"), D("-12500.00")),
    ]
    # Ann: 2020-01-01 -> 2022-01-01 = 731 days; Di: 2021-01-01 -> 2023-01-01 = 730 days.
    assert rows(r["tenure_before_exit"]) == [("Legal", D("2.00")), ("Sales", D("2.00"))]


def test_hr_tables_round_trip_through_files(spark, tables, tmp_path):
    from churnscope.sources.hr import read_hr_tables

    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        df.write.option("header", True).csv(str(tmp_path / name))
    for fmt, opts in (("parquet", {}), ("csv", {"header": True})):
        back = read_hr_tables(spark, str(tmp_path), fmt, **opts)
        assert rows(hr_report(back)["attrition_by_department"]) == rows(
            hr_report(tables)["attrition_by_department"])


def test_command_line_writes_every_result(spark, tables, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for name, df in tables.items():
        df.write.option("header", True).csv(str(src / name))
    main(["--input", str(src), "--format", "csv", "--output", str(out)])
    back = spark.read.parquet(str(out / "attrition_by_department"))
    assert rows(back) == rows(hr_report(tables)["attrition_by_department"])
    assert len(list(out.iterdir())) == len(hr_report(tables))


def test_wide_ids_survive_and_bad_numbers_fail(spark, tmp_path):
    from churnscope.sources.hr import SCHEMAS, read_hr_tables

    for name, schema in SCHEMAS.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(",".join(schema.fieldNames()) + "\n")
    row = "3000000000,Ann,Lee,1,Sales Rep,2020-01-01,F,30,3,Active\n"
    (tmp_path / "departments" / "part.csv").write_text("department_id,department_name\n1,Sales\n")
    head = ",".join(SCHEMAS["employees"].fieldNames()) + "\n"
    (tmp_path / "employees" / "part.csv").write_text(head + row)
    r = hr_report(read_hr_tables(spark, str(tmp_path), "csv", header="true"))
    assert rows(r["employees_clean"], "employee_id", "clean_department_id") == [(3000000000, 1)]
    (tmp_path / "employees" / "part.csv").write_text(head + row.replace("3000000000", "3x"))
    bad = read_hr_tables(spark, str(tmp_path), "csv", header="true")["employees"]
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        bad.collect()


QUESTION = """SELECT d.department_name, count(e.employee_id) AS total, count(a.employee_id) AS leavers
    FROM employees_clean e JOIN departments d ON e.clean_department_id = d.department_id
    LEFT JOIN attrition a ON a.employee_id = e.employee_id
    GROUP BY d.department_id, d.department_name"""


def _staged_folders(spark):
    root = checkpoint_root(spark).removeprefix("file://").removeprefix("file:")
    return set(os.listdir(f"{root}/churnscope")) if os.path.isdir(f"{root}/churnscope") else set()


@pytest.mark.parametrize("staged", [True, False])
def test_views_live_from_create_to_drop(spark, tables, staged):
    before = _staged_folders(spark)
    views = create_views(tables, staged=staged)
    assert rows(views.sql(QUESTION)) == [("Legal", 2, 1), ("Ops", 2, 0), ("Sales", 3, 1)]
    assert spark.table("salary_clean").count() == 9
    plan = views.sql(QUESTION)._jdf.queryExecution().executedPlan().toString()
    assert ("Window" in plan) != staged  # staged: the deduplication is not done again
    views.create()  # replaces, as DROP VIEW IF EXISTS and CREATE VIEW do
    assert rows(views.sql(QUESTION)) == [("Legal", 2, 1), ("Ops", 2, 0), ("Sales", 3, 1)]
    views.drop()
    views.drop()
    assert not {v.name for v in spark.catalog.listTables()} & {"employees_clean", "salary_clean", *tables}
    assert _staged_folders(spark) == before


def test_views_count_while_they_are_written(spark, tables):
    lazy = {r.check_name: tuple(r) for r in hr_report(tables)["verification"].collect()}
    before = _staged_folders(spark)
    with CleanViews(tables) as views:
        assert {r.check_name: tuple(r) for r in views.verification().collect()} == lazy
        assert views.counts["clean_salary_rows"] == 9
        wanted = {r.check_name: r.passed for r in views.verification({"raw_employees": 3, "raw_salary_rows": views.counts["raw_salary_rows"]}).collect()}
        assert wanted["raw_employees"] is False and wanted["raw_salary_rows"] is True
    assert _staged_folders(spark) == before
    with pytest.raises(RuntimeError, match="staged"):
        views.verification()


def test_a_broken_view_does_not_pass(tables, monkeypatch):
    monkeypatch.setattr(cohort, "clean_measures", lambda m: m)
    monkeypatch.setattr(cohort, "clean_people", lambda p, *a, **k: p.withColumn("clean_unit_id", p["unit_id"]))
    with CleanViews(tables) as views:
        passed = {r.check_name: r.passed for r in views.verification().collect()}
    assert passed["clean_salary_rows"] is passed["clean_employees"] is passed["remaining_bad_depts"] is False


def test_command_line_collation_expectations_and_sql(spark, tables, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for name, df in tables.items():
        df.write.option("header", True).csv(str(src / name))
    (tmp_path / "by_unit.sql").write_text(QUESTION + ";\n")
    raw = tables["employees"].count()
    main([
        "--input", str(src), "--format", "csv", "--output", str(out), "--collation", "case_insensitive",
        "--expect", f"raw_employees={raw}", "--expect", "raw_salary_rows=1", "--sql", str(tmp_path / "by_unit.sql"),
    ])
    passed = {r.check_name: r.passed for r in spark.read.parquet(str(out / "verification")).collect()}
    assert passed["raw_employees"] is True and passed["raw_salary_rows"] is False
    assert rows(spark.read.parquet(str(out / "by_unit"))) == [("Legal", 2, 1), ("Ops", 2, 0), ("Sales", 3, 1)]
    with pytest.raises(SystemExit, match="raw_staff"):
        main(["--input", str(src), "--output", str(out), "--expect", "raw_staff=1"])


def test_staged_report_equals_the_lazy_one(spark, tables):
    from churnscope.plans import staging

    lazy = hr_report(tables)
    with staging.staged_files():
        staged = hr_report(tables, staged=True)
        for name, df in lazy.items():
            assert rows(df) == rows(staged[name]), name


def test_expected_counts_in_the_verification(tables):
    r = hr_report(tables, given={"raw_employees": 10, "clean_salary_rows": 8})
    checks = {x.check_name: x.passed for x in r["verification"].collect()}
    assert checks["raw_employees"] is True and checks["clean_salary_rows"] is False
