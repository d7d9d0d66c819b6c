"""Benchmark logs: parse, tag, average, merge devices, compare.

Lines are (file, chunk, seq, value) as ``sources.logs`` gives them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The line formats of the logs.
_TAG = r"D=(\d+)\s+B=(\d+)"
_BODY = r"Timing \(ms\):\s+gen\s+([\d.]+)\s+infer\s+([\d.]+)\s+weights\s+([\d.]+)\s+total\s+([\d.]+)"
TAGGED = {"gpu": rf"{_TAG}\s+{_BODY}", "cpu": rf"{_TAG}\s+(?:CPU\s+)?{_BODY}"}
TAG_WORD, BODY_WORD = "D=", "Timing (ms):"
STAGES = ("gen", "infer", "weights", "total")
# The labels of the stacked bars.
STAGE_LABELS = ("Generation", "Inference", "Weights")
KEY = ["D", "B"]


def _kind(kind: str) -> str:
    if kind not in TAGGED:
        raise ValueError(f"a log is of the 'cpu' or the 'gpu', not {kind!r}")
    return kind


def _match(pattern: str) -> Column:
    """The matched text, '' without a match.

    One regular expression per pattern, and only on lines that hold the words the pattern needs.
    """
    needed = [F.contains("value", F.lit(word)) for word in (TAG_WORD, BODY_WORD) if word in pattern.replace("\\", "")]
    return F.when(reduce(Column.__and__, needed), F.regexp_extract("value", pattern, 0)).otherwise("")


def _times(text: Column) -> Column:
    """The four stage times at the end of a matched text, NULL without a match."""
    words = F.split(text, r"\s+")
    places = dict(zip(STAGES, (-7, -5, -3, -1)))
    times = F.struct(*[F.element_at(words, at).cast("double").alias(s) for s, at in places.items()])
    return F.when(text != "", times)


def _tag(text: Column) -> Column:
    """(D, B) at the start of a matched text, NULL without a match."""
    words = F.split(text, r"\s+")
    parts = [F.substr(F.get(words, F.lit(i)), F.lit(3)).cast("int").alias(k) for i, k in enumerate(KEY)]
    return F.when(text != "", F.struct(*parts))


def _candidates(lines: DataFrame) -> DataFrame:
    """Lines that can match any pattern, by plain substring search."""
    return lines.where(F.contains("value", F.lit(BODY_WORD)) | F.contains("value", F.lit(TAG_WORD)))


def parse_tagged(lines: DataFrame, kind: str = "gpu") -> DataFrame:
    """Lines that hold their own D and B right before the times."""
    rows = _candidates(lines).withColumn("own", _match(TAGGED[_kind(kind)])).where("own <> ''")
    own = F.col("own")
    return rows.select("file", "chunk", "seq", _tag(own).alias("tag"), _times(own).alias("t")).select(
        "file", "chunk", "seq", "tag.*", "t.*"
    )


def carry_tags(lines: DataFrame, tag: str = "tag") -> DataFrame:
    """Add ``current``: the last non-NULL tag at or before the line in its file.

    One file may hold most lines, so no window spans a file's lines: the last tag of every chunk is
    carried over the chunks (one row each), and the lines only look back inside their chunk.
    """
    last_at = F.when(F.col(tag).isNotNull(), F.col("seq"))
    chunks = lines.groupBy("file", "chunk").agg(F.max_by(tag, last_at).alias("_last"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("_carry_in", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    upto = Window.partitionBy("file", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        lines.withColumn("_own", F.last(tag, ignorenulls=True).over(upto))
        .join(carried, ["file", "chunk"])
        .withColumn("current", F.coalesce("_own", "_carry_in"))
        .drop("_own", "_carry_in")
    )


def _single_device(lines: DataFrame, kind: str) -> DataFrame:
    """Lines with times, whether they are complete (``own``) and the (D, B) they belong to.

    A complete line does not set the tag for the bare lines after it.
    """
    texts = _candidates(lines).select(
        "file", "chunk", "seq", _match(TAGGED[_kind(kind)]).alias("own_text"), _match(_TAG).alias("tag_text"),
        _match(_BODY).alias("body_text"),
    )
    complete = F.col("own_text") != ""
    rows = texts.select(
        "file", "chunk", "seq", _tag(F.col("own_text")).alias("own"),
        F.when(~complete, _tag(F.col("tag_text"))).alias("tag"),
        F.coalesce(_times(F.col("own_text")), _times(F.col("body_text"))).alias("t"),
    )
    return (
        carry_tags(rows)
        .withColumn("key", F.coalesce("own", "current"))
        .where(F.col("t").isNotNull() & F.col("key").isNotNull())
    )


def parse_bare(lines: DataFrame, kind: str = "gpu") -> DataFrame:
    """Times without an adjoining D and B: they belong to the last tag seen, or are dropped."""
    rows = _single_device(lines, kind).where(F.col("own").isNull())
    return rows.select("file", "chunk", "seq", "key.*", "t.*")


def parse_log(lines: DataFrame, kind: str = "gpu") -> DataFrame:
    """All runs of a single-device log: complete lines and bare lines under their tag."""
    return _single_device(lines, kind).select("file", "chunk", "seq", "key.*", "t.*")


def drop_first(runs: DataFrame, n: int = 0) -> DataFrame:
    """Without the first n runs of every (D, B) in log order, unless that would leave none.

    Only the first n + 1 runs per key are ranked (the rank filter limits every task to so many rows per key before the
    shuffle); the others are compared with the n-th of them.  Nothing runs while the plan is built.
    """
    if n <= 0:
        return runs
    order = F.struct("file", "chunk", "seq")
    first = Window.partitionBy(*KEY).orderBy("file", "chunk", "seq")
    ends = (
        runs.select(*KEY, "file", "chunk", "seq")
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n + 1)
        .groupBy(*KEY)
        .agg(F.max(F.when(F.col("rank") <= n, order)).alias("end"), F.max("rank").alias("runs"))
    )
    return runs.join(ends, KEY).where((F.col("runs") <= n) | (order > F.col("end"))).drop("end", "runs")


def mean_by_key(runs: DataFrame, drop: int = 0) -> DataFrame:
    """Mean times and number of runs of every (D, B), without its first ``drop`` runs unless those are all.

    The times of the first runs are taken off the sums of all, so nothing is joined to the runs.  For ``drop=1`` the
    first run is the smallest (place, times) struct, found in the same pass; beyond, a task ranks ``drop`` rows per key.
    """
    if drop <= 0:
        return runs.groupBy(*KEY).agg(*[F.avg(s).alias(s) for s in STAGES], F.count(F.lit(1)).alias("runs"))
    sums = [F.sum(s).alias(f"all_{s}") for s in STAGES]
    if drop == 1:
        first = F.min(F.struct("file", "chunk", "seq", *STAGES)).alias("first")
        once = runs.groupBy(*KEY).agg(*sums, F.count(F.lit(1)).alias("all_runs"), first)
        more = F.col("all_runs") > 1
        left = F.when(more, F.col("all_runs") - 1).otherwise(F.col("all_runs"))
        off = {s: F.when(more, F.col(f"first.{s}")).otherwise(0.0) for s in STAGES}
        return once.select(*KEY, *[((F.col(f"all_{s}") - off[s]) / left).alias(s) for s in STAGES], left.alias("runs"))
    place = Window.partitionBy(*KEY).orderBy("file", "chunk", "seq")
    ranked = runs.select(*KEY, "file", "chunk", "seq", *STAGES).withColumn("rank", F.row_number().over(place))
    head = ranked.where(F.col("rank") <= drop).groupBy(*KEY).agg(*[F.sum(s).alias(f"first_{s}") for s in STAGES])
    whole = runs.groupBy(*KEY).agg(*sums, F.count(F.lit(1)).alias("all_runs"))
    more = F.col("all_runs") > drop
    left = F.when(more, F.col("all_runs") - drop).otherwise(F.col("all_runs"))
    return whole.join(head, KEY).select(
        *KEY,
        *[((F.col(f"all_{s}") - F.when(more, F.col(f"first_{s}")).otherwise(0.0)) / left).alias(s) for s in STAGES],
        left.alias("runs"),
    )


def parse_combined(lines: DataFrame) -> DataFrame:
    """One log with both devices: (kind, D, B, times) of the last line of every (kind, D, B).

    Every tag is remembered, also that of a complete line.  A bare line is of the CPU if it says so.
    """
    texts = _candidates(lines).select(
        "file", "chunk", "seq", F.contains("value", F.lit("CPU")).alias("says_cpu"), _match(_TAG).alias("tag_text"),
        _match(TAGGED["cpu"]).alias("own_text"), _match(_BODY).alias("body_text"),
    )
    own = F.col("own_text")
    rows = texts.select(
        "file", "chunk", "seq", "says_cpu", _tag(F.col("tag_text")).alias("tag"), _tag(own).alias("own"),
        F.contains(own, F.lit("CPU")).alias("own_is_cpu"),
        F.coalesce(_times(own), _times(F.col("body_text"))).alias("t"),
    )

    def device(is_cpu: str) -> Column:
        return F.when(F.col(is_cpu), "cpu").otherwise("gpu")

    complete = F.col("own").isNotNull()
    bare = F.col("t").isNotNull() & (F.col("current.D") != 0)
    entries = carry_tags(rows).select(
        F.when(complete, device("own_is_cpu")).when(bare, device("says_cpu")).alias("kind"),
        F.coalesce("own", "current").alias("key"), "t", F.struct("file", "chunk", "seq").alias("at"),
    )
    return (
        entries.where(F.col("kind").isNotNull())
        .select("kind", "key.D", "key.B", "t", "at")
        .groupBy("kind", *KEY)
        .agg(F.max_by("t", "at").alias("t"))
        .select("kind", *KEY, "t.*")
    )


def merge_devices(gpu: DataFrame, cpu: DataFrame) -> DataFrame:
    """All (D, B) of either device, NULL where one is missing."""
    def side(df, name):
        return df.select(*KEY, *[F.col(s).alias(f"{name}_{s}") for s in STAGES])

    return side(gpu, "gpu").join(side(cpu, "cpu"), KEY, "full_outer")


def speedup(merged: DataFrame) -> DataFrame:
    return merged.withColumn("speedup", F.try_divide("cpu_total", "gpu_total"))


def speedup_matrix(merged: DataFrame, b_values: Sequence[int]) -> DataFrame:
    """D rows by ``b_values`` columns (``b_<B>``); a repeated (D, B) is an error."""
    once = (
        speedup(merged).groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("n"), F.max("speedup").alias("speedup"))
        .withColumn(
            "speedup",
            F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate entry for D, B = "), F.concat_ws(", ", *KEY))).cast("double"))
            .otherwise(F.col("speedup")),
        )
    )
    wide = once.groupBy("D").pivot("B", list(b_values)).agg(F.max("speedup"))
    return wide.select("D", *[F.col(str(b)).alias(f"b_{b}") for b in b_values])


def stage_breakdown(merged: DataFrame, device: str = "gpu") -> DataFrame:
    """Stacked bars: value and bottom of gen, infer and weights for every (D, B)."""
    parts, bottom = [], F.lit(0.0)
    for i, (stage, label) in enumerate(zip(STAGES, STAGE_LABELS)):
        value = F.col(f"{device}_{stage}")
        parts.append(
            F.struct(
                F.lit(i).alias("stage_no"), F.lit(label).alias("stage"), value.alias("value"), bottom.alias("bottom")
            )
        )
        bottom = bottom + value
    return merged.select(*KEY, F.explode(F.array(*parts)).alias("p")).select(*KEY, "p.*")


def total_series(merged: DataFrame) -> DataFrame:
    """Total time over B, one series per D and device."""
    lines = F.array(
        F.struct(F.lit("gpu").alias("device"), F.col("gpu_total").alias("total")),
        F.struct(F.lit("cpu").alias("device"), F.col("cpu_total").alias("total")),
    )
    series = merged.select(*KEY, F.explode(lines).alias("s")).select("D", "s.device", "B", "s.total")
    return series.where(F.col("total").isNotNull())


def sweep_grid(spark, d_values: Sequence[int], b_values: Sequence[int], runs: int) -> DataFrame:
    """Every (D, B, run) of a sweep, from three short given lists."""
    def listed(values):
        return F.explode(F.array(*[F.lit(int(v)) for v in values]))

    return (
        spark.range(1)
        .select(listed(d_values).alias("D"))
        .select("D", listed(b_values).alias("B"))
        .select("D", "B", listed(range(1, runs + 1)).alias("run"))
    )


def grid_values(merged: DataFrame) -> DataFrame:
    """One row (d_values, b_values): the different D and B that a table of timings holds, in order; nulls are left out."""
    return merged.agg(F.sort_array(F.collect_set("D")).alias("d_values"), F.sort_array(F.collect_set("B")).alias("b_values"))
