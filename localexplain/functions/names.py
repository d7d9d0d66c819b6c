"""Feature names in reports.  Names are a list of D strings or None (then ``feature_<i>``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reports: name marker, group and label suffix.
ERROR_MARK, MEAN_MARK, WORST_MARK = " error", "mean ", "worst "


def feature_name(idx: Column, names: Sequence[str] | None) -> Column:
    fallback = F.concat(F.lit("feature_"), idx.cast("string"))
    if not names:
        return fallback
    known = F.try_element_at(F.array(*[F.lit(n) for n in names]), (idx + 1).cast("int"))
    return F.coalesce(known, fallback)


def feature_group(name: Column) -> Column:
    return (
        F.when(F.contains(name, F.lit(ERROR_MARK)), "error")
        .when(F.startswith(name, F.lit(MEAN_MARK)), "mean")
        .when(F.startswith(name, F.lit(WORST_MARK)), "worst")
        .otherwise("other")
    )


def display_name(name: Column) -> Column:
    def marked(mark: str, label: str) -> Column:
        return F.concat(F.replace(name, F.lit(mark), F.lit("")), F.lit(f" [{label}]"))

    group = feature_group(name)
    return (
        F.when(group == "error", marked(ERROR_MARK, "error"))
        .when(group == "mean", marked(MEAN_MARK, "mean"))
        .when(group == "worst", marked(WORST_MARK, "worst"))
        .otherwise(name)
    )


def direction(coefficient: Column) -> Column:
    """Zero counts as negative."""
    return F.when(coefficient > 0, "positive").otherwise("negative")
