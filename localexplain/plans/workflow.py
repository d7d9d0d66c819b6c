"""The whole evaluation of a black box in one go: train, fit every solver on one set of sums, compare, check, ablate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.operators import agree, prep, report
from localexplain.operators.fit import SOLVERS, check_solvers, local_delta
from localexplain.plans.explain import explain
from localexplain.sources.models import Model


def kept(df: DataFrame) -> DataFrame:
    """Fit rows, D numbers each, kept while several reports read them; lost ones are made again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@dataclass(frozen=True)
class Evaluation:
    model: Model
    background: list[float]
    accuracy: DataFrame
    fits: DataFrame
    pairs: DataFrame
    consistency: DataFrame
    ablation: DataFrame


def evaluate(
    train: DataFrame, test: DataFrame, solvers: Sequence[str] = SOLVERS, k: int = 10, limit: float = 0.1,
    max_features: int = 20, digits: int | None = 9, keep: Callable[[DataFrame], DataFrame] = kept, c: float = 1.0,
    n_samples: int = 16384, mask_prob: float = 0.2, noise_std: float = 0.1, kernel_width: float = 1.0, seed: int = 1234,
    **options,
) -> Evaluation:
    """Train on (x, label) rows, then explain every (row_id, x) row of ``test`` with all solvers and report on the fits.

    The solvers share one pass over the samples.  ``keep`` says how the fit rows are kept between the reports: persisted
    unless another function, for example one that writes and reads a table, is given.
    """
    names = check_solvers(solvers)
    model = prep.train_black_box(train, c)
    background = prep.as_vector(prep.background_means(train, model.d), model.d, digits)
    instances = test.select(F.col("row_id").alias("instance_id"), F.col("x").alias("x0"))
    sampling = {
        "n_samples": n_samples, "mask_prob": mask_prob, "noise_std": noise_std, "kernel_width": kernel_width, "seed": seed,
    }
    fits = keep(explain(instances, model, background, solver=names, **sampling, **options))
    return Evaluation(
        model, background,
        prep.accuracy(test, model),
        fits,
        agree.compare_pairs(fits.withColumn("source", F.col("solver")), names, k),
        report.consistency(fits, limit),
        report.ablation_curve(fits, model, background, max_features, **sampling),
    )


def long_report(done: Evaluation) -> DataFrame:
    """One table (instance_id, part, subject, k, value) of everything an evaluation says about an instance.

    Parts: r2, delta and pass (0 or 1) by solver, cosine / spearman / overlap by pair of solvers, wmae by solver and k.
    """

    def entries(df: DataFrame, subject, k, **values) -> DataFrame:
        parts = [F.struct(F.lit(name).alias("part"), v.cast("double").alias("value")) for name, v in values.items()]
        rows = df.select("instance_id", subject.alias("subject"), k.cast("int").alias("k"), F.explode(F.array(*parts)).alias("e"))
        return rows.select("instance_id", "e.part", "subject", "k", "e.value")

    none, solver = F.lit(None), F.col("solver")
    pair = F.concat_ws("-", "source_a", "source_b")
    return (
        entries(done.fits, solver, none, r2=F.col("r2"), delta=local_delta())
        .unionAll(entries(done.consistency, solver, none, **{"pass": F.col("status") == "PASS"}))
        .unionAll(entries(done.pairs, pair, none, cosine=F.col("cosine"), spearman=F.col("spearman"), overlap=F.col("overlap")))
        .unionAll(entries(done.ablation, solver, F.col("k"), wmae=F.col("wmae")))
    )
