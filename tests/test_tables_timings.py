import pytest
from pyspark.sql import functions as F

from localexplain.operators import timings
from localexplain.operators.perturb import perturb
from localexplain.plans.explain import explain, scored_samples
from localexplain.plans.sweep import sweep_fidelity
from localexplain.sources import logs, models, tables
from localexplain.sources.models import Model


def test_model_round_trip_and_damage(spark, tmp_path):
    path = str(tmp_path / "m")
    inst = models.synthetic_instances(spark, 2, n=3)
    model = Model((0.5, -0.25), 0.125, "m1", "demo", 0.9)
    models.write_model(model, [0.1, 0.2], ["a", "b"], inst, path)
    got, bg, names, rows = models.read_model(spark, path)
    assert got == model and bg == [0.1, 0.2] and names == ["a", "b"] and rows.count() == 3
    with pytest.raises(ValueError):
        models.write_model(model, [0.1], ["a", "b"], inst, path)
    spark.createDataFrame([(0, 0.1)], "feature_idx INT, mean DOUBLE").write.mode("overwrite").parquet(f"{path}/background")
    with pytest.raises(ValueError, match="background"):
        models.read_model(spark, path)
    with pytest.raises(Exception):
        models.read_model(spark, str(tmp_path / "absent"))


def test_samples_scores_fits_round_trip(spark, tmp_path):
    inst, model, bg = models.synthetic_instances(spark, 3, n=2), models.synthetic_model(3), [0.5] * 3
    samples = perturb(inst, bg, 10)
    tables.write_samples(samples, str(tmp_path / "s"), "m1")
    back = tables.read_samples(spark, str(tmp_path / "s"), "m1")
    assert back.count() == 20 and tables.read_samples(spark, str(tmp_path / "s"), "m2").count() == 0
    tables.write_samples(samples.drop("z"), str(tmp_path / "nz"))
    assert tables.read_samples(spark, str(tmp_path / "nz")).where("z IS NULL").count() == 20
    tables.generate_samples(inst, bg, str(tmp_path / "g"), 10, seed=1234)
    same = tables.read_samples(spark, str(tmp_path / "g")).drop("model_id")
    assert same.exceptAll(back.drop("model_id")).count() == 0 and same.count() == 20
    scored = scored_samples(inst, model, samples=back.drop("model_id"))
    tables.write_scores(scored, str(tmp_path / "c"))
    stored = tables.read_scores(spark, str(tmp_path / "c"))
    bundle = tables.bundle_outputs(back, stored, back)
    assert bundle.count() == 20 and bundle.where("z IS NULL").count() == 0
    assert tables.bundle_outputs(back, stored).where("z IS NULL").count() == 20
    fits = explain(inst, model, bg, n_samples=10)
    tables.write_fits(fits, str(tmp_path / "f"))
    loaded = tables.read_fits(spark, {"mine": str(tmp_path / "f"), "other": None})
    assert [r.source for r in loaded.collect()] == ["mine", "mine"] and "feature_names" in loaded.columns


def test_normalize_fits(spark):
    raw = spark.createDataFrame(
        [(0, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])], "instance_id BIGINT, solver_id INT, coeff ARRAY<DOUBLE>"
    )
    inst = models.synthetic_instances(spark, 2, n=1)
    rows = tables.normalize_fits(raw, inst, ["a"]).orderBy("instance_id").collect()
    assert [r.solver for r in rows] == ["cholesky", "gd"] and rows[0].x0 == [1.0, 0.5] and rows[1].x0 is None
    assert rows[0].feature_names == ["a", "feature_1"] and rows[0].loss is None
    assert tables.normalize_fits(raw, inst).first().feature_names is None


T = "Timing (ms): gen {0}  infer {0}.5  weights 0.25  total {0}.75"


def lines_of(spark, lines, per_chunk=2):
    df = spark.createDataFrame([("log", i, v) for i, v in enumerate(lines)], "file STRING, line_no BIGINT, value STRING")
    return logs.number_lines(df, per_chunk=per_chunk)


def seen(df):
    return [(r.D, r.B, r.gen) for r in df.orderBy("chunk", "seq").collect()]


def test_single_device_log(spark):
    log = [
        T.format(1),                           # before any tag: dropped
        "D=128 B=64 run=1 " + T.format(2),     # tag and bare times in one line
        "noise", "noise", "noise",
        T.format(3),                           # carried over several chunks
        "D=256 B=32 " + T.format(4),           # complete, does not set the tag
        T.format(5),                           # still 128, 64
        "D=512 B=16 CPU " + T.format(6),       # for gpu: a tag with bare times
        "  CPU " + T.format(7) + "  ",
        "Timing detail (ms): gen_init 1 perturb 2 read_x_io 3",
    ]
    gpu, cpu = lines_of(spark, log), lines_of(spark, log, per_chunk=3)
    assert seen(timings.parse_tagged(gpu, "gpu")) == [(256, 32, 4.0)]
    assert seen(timings.parse_tagged(cpu, "cpu")) == [(256, 32, 4.0), (512, 16, 6.0)]
    assert seen(timings.parse_bare(gpu, "gpu")) == [(128, 64, 2.0), (128, 64, 3.0), (128, 64, 5.0), (512, 16, 6.0), (512, 16, 7.0)]
    assert seen(timings.parse_log(cpu, "cpu")) == [
        (128, 64, 2.0), (128, 64, 3.0), (256, 32, 4.0), (128, 64, 5.0), (512, 16, 6.0), (128, 64, 7.0)
    ]
    with pytest.raises(ValueError):
        timings.parse_tagged(gpu, "tpu")


def test_drop_first_and_means(spark):
    log = [f"D=1 B=1 {T.format(v)}" for v in (9, 1, 3)] + [f"D=2 B=1 {T.format(5)}"]
    runs = timings.parse_log(lines_of(spark, log))
    assert seen(timings.drop_first(runs, 1)) == [(1, 1, 1.0), (1, 1, 3.0), (2, 1, 5.0)]
    assert seen(timings.drop_first(runs, 3)) == seen(runs) == seen(timings.drop_first(runs, 0))
    means = {r.D: r for r in timings.mean_by_key(timings.drop_first(runs, 1)).collect()}
    assert (means[1].gen, means[1].total, means[1].runs) == (2.0, 2.75, 2) and means[2].gen == 5.0


def test_combined_log_last_value_wins(spark):
    log = [
        T.format(1), "D=8 B=4 " + T.format(2), T.format(3), "CPU " + T.format(4), "D=8 B=4 CPU " + T.format(5),
        "D=0 B=7", T.format(6), "D=9 B=1 x " + T.format(7),
    ]
    rows = {(r.kind, r.D, r.B): r.gen for r in timings.parse_combined(lines_of(spark, log)).collect()}
    assert rows == {("gpu", 8, 4): 3.0, ("cpu", 8, 4): 5.0, ("gpu", 9, 1): 7.0}


def test_text_logs_keep_order_across_splits(spark, tmp_path):
    path = tmp_path / "gpu.txt"
    log = []
    for i in range(300):
        log += [f"D={i + 1} B=7", "noise " * 5, T.format(i), T.format(i + 1000)]
    path.write_text("\n".join(log) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = logs.read_timing_logs(spark, str(path))
        assert lines.select("chunk").distinct().count() > 5
        runs = timings.parse_log(lines)
        got = [(r.D, r.gen) for r in runs.orderBy("chunk", "seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i + 1, float(v)) for i in range(300) for v in (i, i + 1000)]


def test_missing_logs(spark, tmp_path):
    with pytest.warns(UserWarning, match="not found"):
        assert logs.read_timing_logs(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(FileNotFoundError):
        logs.read_timing_logs(spark, str(tmp_path / "none.txt"), missing_ok=False)


def device(spark, rows):
    return spark.createDataFrame(rows, "D INT, B INT, gen DOUBLE, infer DOUBLE, weights DOUBLE, total DOUBLE")


def test_merge_write_read_and_charts(spark, tmp_path):
    gpu = device(spark, [(1, 10, 1.0, 2.0, 3.0, 6.0), (2, 10, 1.0, 1.0, 1.0, 0.0)])
    cpu = device(spark, [(1, 10, 5.0, 5.0, 5.0, 24.0), (1, 20, 1.0, 1.0, 1.0, 3.0), (2, 10, 1.0, 1.0, 1.0, 3.0)])
    merged = timings.merge_devices(gpu, cpu)
    path = str(tmp_path / "t.csv")
    logs.write_timings(merged, path)
    back = logs.read_timings(spark, path)
    assert [(r.D, r.B, r.gpu_total, r.cpu_total) for r in back.orderBy("D", "B").collect()] == [
        (1, 10, 6.0, 24.0), (1, 20, None, 3.0), (2, 10, 0.0, 3.0)
    ]
    assert [r.speedup for r in timings.speedup(back).orderBy("D", "B").collect()] == [4.0, None, None]
    matrix = {r.D: r for r in timings.speedup_matrix(back, [10, 20]).collect()}
    assert matrix[1].b_10 == 4.0 and matrix[1].b_20 is None
    with pytest.raises(Exception, match="duplicate entry"):
        timings.speedup_matrix(back.unionAll(back), [10, 20]).collect()
    bars = [(r.stage, r.value, r.bottom) for r in timings.stage_breakdown(back).where("D = 1 AND B = 10").orderBy("stage_no").collect()]
    assert bars == [("Generation", 1.0, 0.0), ("Inference", 2.0, 1.0), ("Weights", 3.0, 3.0)]
    series = {(r.D, r.device, r.B) for r in timings.total_series(back).collect()}
    assert series == {(1, "gpu", 10), (1, "cpu", 10), (1, "cpu", 20), (2, "gpu", 10), (2, "cpu", 10)}
    with pytest.raises(ValueError):
        logs.write_timings(merged.where("false"), path)
    merged.drop("gpu_gen").write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="gpu_gen"):
        logs.read_timings(spark, str(tmp_path / "bad"))


def test_sweep(spark):
    assert timings.sweep_grid(spark, [128, 256], [10, 20, 30], 2).distinct().count() == 12
    inst, model, bg = models.synthetic_instances(spark, 4, n=5), models.synthetic_model(4), [0.5] * 4
    rows = sweep_fidelity(inst, model, bg, [2, 4], [30], 1).orderBy("D").collect()
    assert [(r.D, r.B, r.run, r.n) for r in rows] == [(2, 30, 1, 5), (4, 30, 1, 5)]
    single = explain(inst, model, bg, n_samples=30, seed=1235).agg(F.avg("r2")).first()[0]
    assert abs(rows[1].mean_r2 - single) < 1e-12
