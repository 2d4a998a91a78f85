"""Small helpers: salts, table paths, rounding, preview."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from churnscope.functions import numeric
from churnscope.functions.salting import row_hash
from churnscope.operators import audit, metrics
from churnscope.plans import cohort
from churnscope.sources import bindings
from churnscope.sources.tables import read_table, table_path
from conftest import person


def test_row_hash_skips_map_columns_and_is_deterministic(spark):
    # xxhash64 cannot hash maps; by default the hash uses the other columns.
    df = spark.createDataFrame([(1, {"a": 1}), (2, {"b": 2})], "id long, m map<string,int>")
    hashes = [r[0] for r in df.select(row_hash(df)).collect()]
    assert hashes == [r[0] for r in df.select(row_hash(df)).collect()]
    assert len(set(hashes)) == 2


def test_table_path_states_its_layout(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(2).write.parquet(str(tmp_path / "b"))
    assert table_path("s3a://bucket/x/", "a") == "s3a://bucket/x/a.parquet"
    assert read_table(spark, str(tmp_path), "a").count() == 3
    assert read_table(spark, f"file://{tmp_path}", "b", suffix="").count() == 2


# (numerator, denominator, rounded to 2 places): exact, half away from zero.
FRACTIONS = [
    (20030, 2000, "10.02"), (-1001, 200, "-5.01"), (1, 200, "0.01"), (-1, 200, "-0.01"), (999999, 200000000, "0.00"),
    (5, -1000, "-0.01"), (0, 7, "0.00"), (7, 0, None), (None, 3, None),
]


def test_rounded_fraction_is_exact(spark):
    df = spark.createDataFrame([(n, d) for n, d, _ in FRACTIONS], "n long, d long")
    got = [r[0] for r in df.select(numeric.rounded_fraction("n", "d")).collect()]
    assert got == [None if x is None else Decimal(x) for _, _, x in FRACTIONS]


def test_rates_near_a_tie(spark):
    df = spark.createDataFrame([(100, 2000001), (1249999999, 40000000000), (1, 0)], "h long, t long")
    got = [r[0] for r in df.select(numeric.rounded_percent("h", "t")).collect()]
    assert got == [Decimal("0.00"), Decimal("3.12"), None]


def test_gap_of_large_groups_rounds_once(spark):
    # 20,001 rows of 0.01 and 0.02 that sum to 300.01: mean 0.01499975.
    rows_ = spark.range(20001).selectExpr(
        "'g' AS g", "'a' AS f", "CAST(IF(id < 10000, 0.02, 0.01) AS DECIMAL(12,2)) AS m"
    )
    assert rows_.agg({"m": "sum"}).first()[0] == Decimal("300.01")
    out = metrics.group_gap(rows_, "g", "m", "f", "a", "b").first()
    assert out["avg_a"] == Decimal("0.01") and out["avg_b"] is None and out["gap"] is None


def test_gap_of_wide_values(spark):
    df = spark.createDataFrame(
        [("g", "a", Decimal("9999999999999.99")), ("g", "b", Decimal("0.01"))], "g string, f string, m decimal(18,2)"
    )
    out = metrics.group_gap(df, "g", "m", "f", "a", "b").first()
    assert out["gap"] == Decimal("9999999999999.98")


def test_dimension_key_of_the_same_name(spark):
    people = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "pid long, unit_id long")
    dim = spark.createDataFrame([(10, "x")], "unit_id long, unit_name string")
    ev = spark.createDataFrame([(1,)], "pid long")
    out = metrics.rate_by_group(people, ev, "pid", ["unit_id", "unit_name"], dim=dim, dim_on=("unit_id", "unit_id"))
    assert [tuple(r) for r in out.collect()] == [(10, "x", 2, 1, Decimal("50.00"))]


def test_ids_of_copies_meet_no_other_customer(spark):
    customers = {73: 1, 1000073: 1}
    tables = {
        "customer": spark.createDataFrame([(k, f"c{k}", n) for k, n in customers.items()], "c_custkey long, c_name string, c_nationkey int"),
        "nation": spark.createDataFrame([(1, "N")], "n_nationkey int, n_name string"),
        "orders": spark.sql(
            "SELECT CAST(c AS BIGINT) o_custkey, CAST(c AS BIGINT) o_orderkey, 'F' o_orderstatus, '5-LOW' o_orderpriority,"
            " TIMESTAMP_NTZ'2020-01-01 00:00:00' o_orderdate, 1.0D o_totalprice FROM VALUES (73), (1000073) AS t(c)"
        ),
    }
    people, exits = bindings.people(tables.__getitem__), bindings.exits(tables.__getitem__)
    ids = [r[0] for r in people.where("person_id IS NOT NULL").select("person_id").collect()]
    assert sorted(ids) == [146, 147, 2000146]
    missing = audit.missing_match_count(people, exits, "person_id", where=F.col("status") == "Terminated")
    assert missing.first()[0] == 1


def test_case_folding_natural_keys(mk):
    p = mk.people([person(1, name="Ann Lee"), person(2, name="ANN LEE")])
    assert cohort.dedup_people(p).count() == 2
    folded = cohort.dedup_people(p, collation="case_insensitive").collect()
    assert [(r.person_id, r.person_name) for r in folded] == [(1, "Ann Lee")]
    groups = audit.duplicate_groups(p, cohort.NATURAL_KEY, collation="case_insensitive")
    assert [(r.person_name, r.occurrences) for r in groups.collect()] == [("ann lee", 2)]


def test_preview_whole_table_ordered(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert [r[0] for r in audit.preview(df, None, "k").collect()] == [1, 2, 3]
