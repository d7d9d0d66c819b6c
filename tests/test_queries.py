"""Every registered query against DuckDB, and the shape of the plans."""

import os
import re
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as contract
from localexplain.operators import moments, report
from localexplain.plans import explain as ex
from localexplain.plans import queries as q
from localexplain.sources import models

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    yield con
    con.close()


def tidy(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True, na_position="first")


def test_every_query_has_sql():
    assert set(q.QUERIES) - set(contract.oracle_sql()) == WITHOUT_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - WITHOUT_SQL))
def test_equals_duckdb(spark, sf, duck, name):
    got = tidy(contract.queries()[name](spark, sf).toPandas())
    expected = tidy(duck.execute(contract.oracle_sql()[name]).df())
    assert list(got.columns) == list(expected.columns) and len(got) == len(expected) > 0
    for c in got.columns:
        if pd.api.types.is_float_dtype(got[c]):
            a, b = got[c].to_numpy(float), expected[c].to_numpy(float)
            assert np.array_equal(a, b, equal_nan=True), (c, np.nanmax(np.abs(a - b)))
        else:
            assert got[c].astype(str).equals(expected[c].astype(str)), c


def test_entry(spark):
    assert contract.entry(spark).columns == ["instance_id", "rank", "feature_idx", "feature", "coefficient"]


def test_trained_model_explains_test_rows(spark, sf):
    assert 0.8 < q.QUERIES["black_box_accuracy"](spark, sf).first().accuracy <= 1.0
    assert q.QUERIES["explain_trained"](spark, sf).count() == 10 * 100


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_no_pair_plans(spark, sf, name):
    nested = re.findall("CartesianProduct|BroadcastNestedLoopJoin", plan(q.QUERIES[name](spark, sf)))
    assert nested == []


def test_narrow_moments_stay_in_the_jvm_and_shuffle_only_instances(spark, sf):
    inst, model, bg = q.parts(spark, sf)
    text = plan(moments.perturbed_moments(inst, model, bg, 50, 0.2, 0.1, 1.0, 1))
    assert "InArrow" not in text and text.count("Exchange") == 1
    full = plan(report.top_k(ex.explain(inst, model, bg, 50), 2))
    assert full.count("Exchange") == 1
    ranges = plan(moments.perturbed_moments(inst, model, bg, 50, 0.2, 0.1, 1.0, 1, chunk=10))
    assert ranges.count("Exchange") == 2


def test_wide_explanation_shuffles_only_instances(spark, sf):
    inst, model, bg = q.embeddings(spark, sf)
    text = plan(ex.explain(inst, model, bg, 50))
    assert text.count("Exchange") == 1 and "HashAggregate" not in text and "SortAggregate" not in text
    assert "Exchange" not in plan(ex.explain(inst, model, bg, 50, partitions=0))


def test_scan_reads_only_needed_columns(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(q.line_instances(spark, sf))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    }


def test_generated_methods_stay_below_the_jit_limit(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        model, bg, inst = models.synthetic_params(spark, moments.UNROLLED_GRAM)
        df = moments.perturbed_moments(inst, model, bg, 50, 0.2, 0.1, 1.0, 1)
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000


def test_adding_a_partition_count_changes_nothing(spark, sf):
    inst, model, bg = q.parts(spark, sf)
    a = ex.explain(inst, model, bg, 20).orderBy("instance_id").toPandas()
    b = ex.explain(inst.repartition(1), model, bg, 20, partitions=3).orderBy("instance_id").toPandas()
    assert np.array_equal(np.stack(a.coeff), np.stack(b.coeff))
    c = ex.explain(inst, model, bg, 20, partitions=0).orderBy("instance_id").toPandas()
    assert np.allclose(np.stack(a.coeff), np.stack(c.coeff), atol=1e-12)


def test_the_mean_of_stored_scores_does_not_depend_on_the_order_of_summation(spark):
    """61 951 876 / 64 000 000 ends in a tie at nine digits: sums in other orders are a few 1e-15 above or below it."""
    means = spark.createDataFrame([(0.9679980625 + k * 1e-15,) for k in range(-9, 10)], "mean_stored double")
    assert {r.mean_stored for r in q.settled(means, "mean_stored").collect()} == {0.967998062}
    assert {r.mean_stored for r in q.settled(means.selectExpr("-mean_stored AS mean_stored"), "mean_stored").collect()} == {-0.967998062}
    assert [r.mean_stored for r in q.settled(spark.sql("SELECT explode(array(0.2749273841, -0.0, null)) AS mean_stored"), "mean_stored").collect()] == [
        0.274927384, 0.0, None,
    ]
