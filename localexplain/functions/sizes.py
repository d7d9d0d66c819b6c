"""Joins that hold at size: salted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT_RUN = 4096  # neighbouring samples of a key that stay together: sums of them are few
SALTS = 16
SALT = "_salt"


def salt_of(salts: int) -> Column:
    """The group of a sample: runs of SALT_RUN go round, and damaged numbers have a group as well."""
    return F.coalesce(F.expr(f"int(pmod(sample_id DIV {SALT_RUN}, {salts}))"), F.lit(0))


def dealt_salts(samples: DataFrame) -> int | None:
    """The number of salts if ``samples`` were made where their instance and salt are dealt to (``perturb(salted=True)``)."""
    return next((f.metadata.get("salts") for f in samples.schema.fields if f.name == SALT), None)


def salted_join(samples: DataFrame, small: DataFrame, keys: list[str], salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join of sample rows to a side with one row per key.

    The samples of one key spread over ``salts`` groups by runs of ``sample_id``; the side with one row per
    key, smaller by the number of samples, is repeated for each salt.  Always a sort-merge join: sizes are estimated
    without the factor of an explode, so a side of any size would pass for one that can be broadcast.  Samples come
    out with those of a key and run next to each other.

    Samples that were made in the partition of their key and salt are neither moved nor sorted: they pass by a hash table
    of the small side's rows of that partition.
    """
    dealt = dealt_salts(samples)
    if dealt is None:
        left, hint = samples.withColumn(SALT, salt_of(salts)), "merge"
    else:
        # a union of sets with other salts would lose rows; a filter leaves the partitioning known, a new column would not
        wrong = f"raise_error('samples were dealt by other salts: drop {SALT} and join again')"
        left, hint, salts = samples.where(F.expr(f"if({SALT} BETWEEN 0 AND {dealt - 1}, true, {wrong})")), "shuffle_hash", dealt
    right = small.selectExpr("*", f"explode(sequence(0, {salts - 1})) AS {SALT}")
    return left.join(right.hint(hint), [*keys, SALT], how).drop(SALT)
