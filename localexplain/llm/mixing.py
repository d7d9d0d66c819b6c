"""Mixing sources to target weights by systematic sampling.

Documents of a source are put in order of size (class, then a hash, then size), so the words taken follow the target as
closely as the documents do: the error stays near the size of one document. All expected copies of a source are equal,
so the prefix sum of expected copies is rank times that number; ranks come from counts of small buckets, never from one
window over a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localexplain.llm.common import n_words, stored, text_of

HASH_BUCKETS = 1024


def _fraction(key: Column) -> Column:
    """A fixed number in [0, 1) for each text."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share_pct: int = 150, cap: int = 2) -> DataFrame:
    """source_key, source_size, target of each source: one row per source.

    Sources in code point order, null last, get the weights in turn. Together they share share_pct percent of all words;
    a target stops at cap times its source's size and the excess goes to the others by weight, until none is above. That
    is the same as filling sources in order of cap / weight. Sums are integers, so any order gives equal results.
    """
    per = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1).cast("long")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (
        per.withColumn("weight", weight)
        .withColumn("hundred", share_pct * F.sum("source_size").over(everything) - 100 * cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", 100 * cap * F.col("source_size") * F.col("rest") <= F.col("weight") * F.col("hundred"))
    )
    # The first source that is not full fixes the level for itself and all after it.
    level = F.min(F.when(~F.col("full"), F.struct(-F.col("rest"), "hundred", "rest"))).over(everything)
    return left.withColumn("level", level).select(
        "source_key",
        "source_size",
        F.when(F.col("full"), (cap * F.col("source_size")).cast("double"))
        .otherwise(F.col("weight") * F.col("level.hundred") / (100.0 * F.col("level.rest")))
        .alias("target"),
    )


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (3, 1, 2), share_pct: int = 150, cap: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: how often the mix emits each document.

    One row per row of docs. A null text has size 0 and is never needed; null sources are a source; a null doc_id is a
    document like others. Repeated rows count as separate documents. Empty tables give no rows.
    """
    size = n_words(text_of())
    bits = F.length(F.bin("size"))
    keyed = stored(
        docs.select("doc_id", "source", size.alias("size"))
        .withColumn("source_key", _key(F.col("source")))
        .withColumn("size_class", bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))"))
        .withColumn("tie", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
        .withColumn("bucket", F.conv(F.substring("tie", 1, 8), 16, 10).cast("long") % HASH_BUCKETS),
        "mix",
    )
    place = ["source_key", "size_class", "bucket"]
    counts = keyed.groupBy(*place).count()
    in_class = Window.partitionBy("source_key", "size_class").orderBy("bucket")
    in_source = Window.partitionBy("source_key").orderBy("size_class")
    before = lambda w, c: F.sum(c).over(w) - F.col(c)
    classes = counts.groupBy("source_key", "size_class").agg(F.sum("count").alias("n")).withColumn("classes_before", before(in_source, "n"))
    starts = counts.withColumn("buckets_before", before(in_class, "count")).join(classes.drop("n"), ["source_key", "size_class"])
    goal = targets(keyed, weights, share_pct, cap)
    starts = starts.join(goal, "source_key").select(
        *place, (F.col("buckets_before") + F.col("classes_before")).alias("start"), "source_size", "target"
    )
    inside = Window.partitionBy(*place).orderBy("size", "tie", "doc_id")
    offset = _fraction(F.concat(F.lit(f"{seed}/"), F.col("source_key")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = (
        keyed.withColumn("within", F.row_number().over(inside))
        .join(starts, place)
        .withColumn("rank", F.col("start") + F.col("within"))
    )
    crossed = F.floor(F.col("rank") * expected + offset) - F.floor((F.col("rank") - 1) * expected + offset)
    return ranked.withColumn("copies", crossed.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix() says, with the columns of docs.

    Rows that share doc_id, source and size are told apart by their order of text, so repeated ids are safe.
    """
    own = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in own.items()), n_words(text_of()).alias("size"))
    same = [own["doc_id"], own["source"], "size"]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.md5(F.coalesce(F.col(own["text"]), F.lit("")).cast("binary")))))
    taken = mix(docs, **options).select("doc_id", "source", F.col("size").alias("m_size"), "copies")
    taken = taken.withColumn("m_nth", F.row_number().over(Window.partitionBy("doc_id", "source", "m_size").orderBy("copies")))
    met = rows.join(
        taken.filter("copies > 0"),
        F.col(own["doc_id"]).eqNullSafe(F.col("doc_id"))
        & F.col(own["source"]).eqNullSafe(F.col("source"))
        & (F.col("size") == F.col("m_size"))
        & (F.col("nth") == F.col("m_nth")),
    )
    repeated = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*(F.col(new).alias(c) for c, new in own.items()))
