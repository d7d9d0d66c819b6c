import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from localexplain.functions import names
from localexplain.operators import agree, report
from localexplain.operators.perturb import perturb
from localexplain.plans.explain import explain
from localexplain.sources import tables
from localexplain.sources.models import synthetic_instances, synthetic_model

NAMES = ["mean radius", "radius error", "worst radius", "mean radius error", "symmetry"]


def fit_rows(spark, coeffs, source="a", **fields):
    schema = (
        "instance_id BIGINT, solver STRING, source STRING, coeff ARRAY<DOUBLE>, intercept DOUBLE, r2 DOUBLE, "
        "surr_x0 DOUBLE, bb_x0 DOUBLE, loss ARRAY<DOUBLE>"
    )
    rows = [
        (i, "cholesky", source, c, fields.get("intercept", 0.5), fields.get("r2"), fields.get("surr_x0", 0.2), 0.25, fields.get("loss"))
        for i, c in enumerate(coeffs)
    ]
    return spark.createDataFrame(rows, schema)


def test_top_k_orders_ties_and_caps(spark):
    fits = fit_rows(spark, [[0.1, -0.5, 0.5, 0.0]])
    rows = report.top_k(fits, 15).orderBy("rank").collect()
    assert [r.feature_idx for r in rows] == [1, 2, 0, 3] and [r.rank for r in rows] == [1, 2, 3, 4]
    assert rows[0].feature == "feature_1"
    assert [r.feature for r in report.top_k(fits, 2, ["a", "b", "c", "d"]).orderBy("rank").collect()] == ["b", "c"]


def test_names(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n STRING").select(
        names.feature_group(F.col("n")).alias("g"), names.display_name(F.col("n")).alias("d")
    ).collect()
    assert [r.g for r in rows] == ["mean", "error", "worst", "error", "other"]
    assert [r.d for r in rows] == ["radius [mean]", "radius [error]", "radius [worst]", "mean radius [error]", "symmetry"]


def test_attribution_table_and_csv(spark, tmp_path):
    fits = fit_rows(spark, [[0.1, -0.5, 0.0, 2.0, 1.0]], r2=0.75)
    table = report.attribution_table(fits, NAMES)
    rows = table.orderBy("line").collect()
    assert [r.direction for r in rows] == ["positive", "negative", "negative", "positive", "positive", "", ""]
    assert [r.group for r in rows][:5] == ["mean", "error", "worst", "error", "other"]
    assert (rows[5].feature, rows[5].coefficient, rows[6].feature, rows[6].coefficient) == ("intercept", 0.5, "weighted_r2", 0.75)
    assert rows[5].abs_coefficient is None
    tables.write_attribution_csv(table, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["instance_id", "solver", "feature", "group", "coefficient", "abs_coefficient", "direction"]
    lines = [tuple(r) for r in back.collect()]
    assert lines[1] == ("0", "cholesky", "radius error", "error", "-0.5", "0.5", "negative")
    assert [line[2] for line in lines[-2:]] == ["intercept", "weighted_r2"] and len(lines) == 7


def test_consistency_importance_and_loss(spark):
    fits = fit_rows(spark, [[0.1, -0.5, 0.0]], loss=[0.5, 0.25])
    assert report.consistency(fits).first().status == "PASS"
    assert report.consistency(fits, 0.04).first().status == "WARN"
    bars = report.importance_data(fits, 2, NAMES).orderBy("bar").collect()
    assert [(b.bar, b.label, b.sign) for b in bars] == [(0, "radius [mean]", "positive"), (1, "radius [error]", "negative")]
    signs = {b.label: b.sign for b in report.importance_data(fits, 5, NAMES).collect()}
    assert signs["radius [worst]"] == "positive"
    assert [(r.epoch, r.loss) for r in report.loss_curve_data(fits).orderBy("epoch").collect()] == [(0, 0.5), (1, 0.25)]


@pytest.mark.parametrize("d, most", [(4, 20), (4, 2), (40, 20)])
def test_ablation_matches_the_samples(spark, d, most):
    inst, model, bg = synthetic_instances(spark, d, n=2), synthetic_model(d), [0.4] * d
    fits = explain(inst, model, bg, n_samples=80)
    x = brute.stack(perturb(inst, bg, 80), "x")
    x0 = brute.stack(inst.selectExpr("*", "0 AS sample_id"), "x0")[:, 0]
    for with_intercept in (False, True):
        got = report.ablation_curve(fits, model, bg, most, with_intercept, n_samples=80).toPandas()
        for row in fits.collect():
            i, coeff = row.instance_id, np.array(row.coeff)
            y, w = brute.scores(x[i], model.w, model.bias), brute.weights(x[i], x0[i])
            order = sorted(range(d), key=lambda j: (-abs(coeff[j]), j))
            cut = x[i].copy()
            curve = got[got.instance_id == i].sort_values("k")["wmae"].to_list()
            assert len(curve) == min(most, d) + 1
            for k, value in enumerate(curve):
                surrogate = cut @ coeff + (row.intercept if with_intercept else 0.0)
                assert abs(value - (w * np.abs(surrogate - y)).sum() / w.sum()) < 1e-9
                if k < len(curve) - 1:
                    cut[:, order[k]] = x[i][:, order[k]].mean()


def agreement(spark, a, b, k=2):
    fits = fit_rows(spark, [a], "a").unionAll(fit_rows(spark, [b], "b", intercept=0.75, r2=0.5))
    return agree.compare_pairs(fits, ["a", "b"], k).first()


def test_agreement_metrics(spark):
    a, b = [3.0, -1.0, 0.5, 0.2], [2.5, 0.4, -0.6, 0.1]
    row = agreement(spark, a, b)
    assert abs(row.cosine - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    ra, rb = np.argsort(np.argsort(np.abs(a))), np.argsort(np.argsort(np.abs(b)))
    assert abs(row.spearman - np.corrcoef(ra, rb)[0, 1]) < 1e-12
    assert row.overlap == 0.5 and abs(row.max_abs_delta - 1.4) < 1e-12
    assert row.intercept_delta == 0.25 and row.r2_delta is None and row.x0_delta == 0.0


def test_agreement_edges(spark):
    assert agreement(spark, [0.0, 0.0], [1.0, 2.0]).cosine == 0.0
    assert agreement(spark, [1.0], [2.0]).spearman == 0.0
    assert agreement(spark, [1.0, 2.0], [1.0, 2.0], k=10).overlap == 0.2
    assert agreement(spark, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0]).spearman == 1.0
    with pytest.raises(ValueError):
        agree.compare_pairs(fit_rows(spark, [[1.0]]), ["a"])


def test_pairs_and_side_by_side(spark):
    fits = tables.load_fits(
        {"a": fit_rows(spark, [[0.1, 0.9], [0.3, 0.2]]).drop("source"), "b": fit_rows(spark, [[1.0, 2.0]]).drop("source", "r2"),
         "none": None, "c": fit_rows(spark, [[5.0, 6.0]]).drop("source")}
    )
    pairs = agree.compare_pairs(fits, ["a", "b", "c"]).collect()
    assert {(p.instance_id, p.source_a, p.source_b) for p in pairs} == {(0, "a", "b"), (0, "a", "c"), (0, "b", "c")}
    wide = agree.side_by_side(fits, ["a", "b", "c"], ["x" * 50, "y"], 1).orderBy("instance_id").collect()
    assert (wide[0].feature, wide[0].a, wide[0].b, wide[0].c) == ("y", 0.9, 2.0, 6.0)
    assert wide[1].feature == "x" * 40 and wide[1].b is None
    assert agree.side_by_side(fits, ["a", "b"], None).count() == 0
    assert agree.source_summary(fits).count() == 4
    with pytest.raises(ValueError):
        tables.load_fits({"none": None})
