"""End-to-end plans: samples with scores and weights, and instances to attributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.functions.sizes import SALTS, salted_join
from localexplain.operators.fit import fit, fitting
from localexplain.operators.moments import perturbed_moments, sample_moments
from localexplain.operators.perturb import SAMPLES_PER_TASK_ROW, UNROLLED_VECTOR, perturb, spread, unique_ids, wide_samples
from localexplain.operators.score import check_width, score, score_at_x0, weigh
from localexplain.sources.models import BatchModel, Model

BlackBox = Model | BatchModel | Callable[[DataFrame], DataFrame]
REPLAY_SALTS = SALTS


def check_setup(model: BlackBox, background, kernel_width: float) -> None:
    """What every plan asks of its parameters, whatever D, B and the kind of black box are."""
    check_width(kernel_width)
    if isinstance(model, Model | BatchModel) and background is not None and len(background) != model.d:
        raise ValueError(f"the model has {model.d} features, the background {len(background)}")


def scored_samples(
    instances: DataFrame,
    model: BlackBox,
    background=None,
    n_samples: int = 16384,
    mask_prob: float = 0.2,
    noise_std: float = 0.1,
    kernel_width: float = 1.0,
    seed: int = 1234,
    method: str = "custom",
    samples: DataFrame | None = None,
    partitions: int | None = None,
    chunk: int = SAMPLES_PER_TASK_ROW,
    keep_vectors: bool = True,
    keys: tuple[str, ...] = ("instance_id",),
) -> DataFrame:
    """Samples with pred, dist and weight: perturbed here, or replayed when ``samples`` is given.

    ``keep_vectors=False`` leaves out x, z and x0 when only the scores are wanted.
    """
    check_setup(model, background, kernel_width)
    if samples is None and isinstance(model, Model | BatchModel) and model.d > UNROLLED_VECTOR and method == "custom":
        ranges = spread(instances, model.d, n_samples, partitions, chunk, keys)
        return wide_samples(ranges, background, mask_prob, noise_std, seed, model, kernel_width, keep_vectors)
    if samples is None:
        samples = perturb(
            instances, background, n_samples, mask_prob, noise_std, seed,
            partitions=partitions, chunk=chunk, keys=keys,
        )
    else:
        samples = matched(with_instances(samples, instances))
    d = model.d if isinstance(model, Model | BatchModel) else None if background is None else len(background)
    scored = weigh(score(samples, model, method), kernel_width, d)
    return scored if keep_vectors else scored.drop("x", "z", "x0")


def with_instances(samples: DataFrame, instances: DataFrame, salts: int = REPLAY_SALTS) -> DataFrame:
    """Stored samples joined to their instance rows, x0 null where the instance is not there.

    One instance may own a third of the samples, so the join is salted by sample.  Instances are never broadcast: there
    may be as many as there are rows in a table.
    """
    return salted_join(samples.drop("x0"), unique_ids(instances, "instance_id"), ["instance_id"], salts, "left")


def matched(samples: DataFrame) -> DataFrame:
    """Rows of ``with_instances`` for a replay: a sample of an unknown instance is an error, not a smaller result."""
    message = F.concat(F.lit("no instance for the samples of "), F.coalesce(F.col("instance_id").cast("string"), F.lit("NULL")))
    x0 = F.when(F.col("x0").isNull(), F.raise_error(message).cast(samples.schema["x0"].dataType)).otherwise(F.col("x0"))
    return samples.withColumn("x0", x0)


def with_stored_scores(samples: DataFrame, instances: DataFrame) -> DataFrame:
    """Stored samples with their instances, their own pred and weight kept."""
    message = F.concat(F.lit("a sample without pred or weight, instance "), F.coalesce(F.col("instance_id").cast("string"), F.lit("NULL")))
    missing = F.col("pred").isNull() | F.col("weight").isNull()
    pred = F.when(missing, F.raise_error(message).cast("double")).otherwise(F.col("pred"))
    rows = matched(with_instances(samples.select("instance_id", "sample_id", "x", "pred", "weight"), instances))
    return rows.withColumn("pred", pred)


def explain(
    instances: DataFrame,
    model: BlackBox,
    background=None,
    n_samples: int = 16384,
    mask_prob: float = 0.2,
    noise_std: float = 0.1,
    kernel_width: float = 1.0,
    seed: int = 1234,
    solver: str | Sequence[str] = "cholesky",
    ridge: float = 1e-3,
    gd_iters: int = 500,
    gd_lr: float = 1e-2,
    epochs: int = 300,
    adam_lr: float = 0.01,
    samples: DataFrame | None = None,
    partitions: int | None = None,
    chunk: int = SAMPLES_PER_TASK_ROW,
    stored_scores: bool = False,
) -> DataFrame:
    """Attributions of every instance: one ``FITS`` row per instance and solver.

    ``instance_id`` must be unique.  The built-in logistic model, black boxes that take arrays (``BatchModel``) and
    generated samples take the one-pass plan, which writes no sample down; a black box on DataFrames, or replayed samples,
    go through ``scored_samples``.  With ``stored_scores`` the ``pred`` and ``weight`` of ``samples`` are taken as they
    are, and only the instances themselves are scored; a null one is an error.
    """
    check_setup(model, background, kernel_width)
    if stored_scores and (samples is None or not {"pred", "weight"} <= set(samples.columns)):
        raise ValueError("stored scores need samples with columns pred and weight")
    if samples is None and isinstance(model, Model | BatchModel):
        return perturbed_moments(
            instances, model, background, n_samples, mask_prob, noise_std, kernel_width, seed,
            partitions, chunk, fitting(solver, ridge, gd_iters, gd_lr, epochs, adam_lr),
        )
    at_x0 = score_at_x0(instances, model)
    rows = with_stored_scores(samples, at_x0) if stored_scores else scored_samples(
        at_x0, model, background, n_samples, mask_prob, noise_std, kernel_width, seed,
        samples=samples, partitions=partitions, chunk=chunk,
    )
    if isinstance(model, Model | BatchModel):
        d = model.d
    elif background is not None:
        d = len(background)
    else:
        raise ValueError("replay with a custom black box needs the background for its length")
    # a replay comes out of its join, and perturbation out of its instances, with an instance's samples in runs
    sums = sample_moments(rows, d, in_runs=True)
    return fit(sums, solver, ridge, gd_iters, gd_lr, epochs, adam_lr)


def refit_samples(
    fits: DataFrame, model: BlackBox, background, n_samples: int = 16384, mask_prob: float = 0.2,
    noise_std: float = 0.1, kernel_width: float = 1.0, seed: int = 1234, **spread,
) -> DataFrame:
    """The scored samples behind ``fits``, each row carrying its fit.

    The draws are a function of the ids, so the samples are made again from the fit rows instead of
    being stored and joined.
    """
    keys = ("instance_id", "solver") if "solver" in fits.columns else ("instance_id",)
    return scored_samples(
        fits, model, background, n_samples, mask_prob, noise_std, kernel_width, seed, keys=keys, **spread
    )
