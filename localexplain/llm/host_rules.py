"""Quality rules judged by host: failures summed by host, rates shrunk to a beta prior of all hosts, verdicts joined back.

A document is measured once (five counts). Each rule says from the counts whether the document fails. A host's failures of
a rule are a draw of its n documents; the prior of the rates is fitted to all hosts by moments, so a host of three documents
stays near the rate of all while a host of thousands keeps its own. What a host is worth then decides about documents that
a rule alone can't judge: on a good host a failed soft rule is forgiven, on a doubtful host it is not, and a host most of
whose documents fail is left out as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from localexplain.llm.common import WORD, join_by_share, stored

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANKS = " \t\n\v\f\r"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Limits:
    """A host over `doubtful` (shrunk rate of a soft rule) has that rule enforced; one over `bad` in any rule is left out."""

    doubtful: float = 0.2
    bad: float = 0.5


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Whether a document fails, by rule: the base rules first, then soft ones that a good host may fail now and then."""
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "letters": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words")),
    }


def repeated_words(words: list[str]) -> int:
    """How many words lie in a window of five words that the text has at least twice. Windows are compared exactly."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key, wide = codes[:n].copy(), len(seen)
    for i in range(1, WINDOW):
        if wide * len(seen) >= 2**63:
            # Numbers of the different keys so far: fewer than words, so the next product fits again.
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            wide = int(key.max()) + 1
        key = key * len(seen) + codes[i : i + n]
        wide *= len(seen)
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + n] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of MEASURES; n_lines are the lines that hold a word."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        sum(map(len, words)),
        sum(1 for _ in SYMBOLS.finditer(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(docs: DataFrame, host: Column, keep: Column) -> DataFrame:
    """(keep, host string, a struct of the counts) of every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [measure(t.as_py()) for t in batch.column("text")]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * len(MEASURES)
            counted = pa.StructArray.from_arrays(columns, names=list(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("keep"), batch.column("host"), counted], names=["keep", "host", "counts"])

    rows = docs.select(keep.alias("keep"), host.cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    counts = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])
    return rows.mapInArrow(run, T.StructType([rows.schema["keep"], T.StructField("host", T.StringType()), T.StructField("counts", counts)]))


def beta_prior(n_hosts: int, n: int, squares: float, failures: int, spread: float) -> tuple[float, float]:
    """(alpha, beta) of the hosts' rates by moments, from sums over hosts of 1, n, n^2, failures and failures^2 / n.

    With one host, or where rates differ no more than draws of one rate would, the prior is as firm as all rows together;
    where no document or every document fails, it is the rate of all with one failure and one success added.
    """
    if n <= 0:
        return 1.0, 1.0
    rate = (failures + 1) / (n + 2)
    within = failures / n * (1 - failures / n)
    room = n - squares / n - (n_hosts - 1)
    share = 0.0
    if within > 0 and room > 0:
        share = ((spread - failures * failures / n) / within - (n_hosts - 1)) / room
    share = min(max(share, 1 / (n + 1)), 0.99)
    strength = 1 / share - 1
    return rate * strength, (1 - rate) * strength


def host_verdicts(hosts: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, int]:
    """(host, n, verdict bigint) and the number of rows, from host, n and f_<rule> sums.

    verdict -1: left out; else a bit for each soft rule (2 for the second of rules(), 4 for the third, ...) that is enforced.
    """
    names = list(rules())
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")]
    for name in names:
        f = F.col(f"f_{name}")
        # Decimals add up to the same sum in any order of the hosts.
        spread = (f.cast("double") * f / F.col("n")).cast("decimal(28,10)")
        sums += [F.sum(f).alias(f"f_{name}"), F.sum(spread).alias(f"s_{name}")]
    total = hosts.agg(*sums).first()
    rows, bad, bits = int(total["n"] or 0), F.lit(False), F.lit(0).cast("bigint")
    for at, name in enumerate(names):
        alpha, beta = beta_prior(total["hosts"], rows, total["squares"] or 0.0, total[f"f_{name}"] or 0, float(total[f"s_{name}"] or 0))
        shrunk = (F.col(f"f_{name}") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
        bad = bad | (shrunk > limits.bad)
        if name != "base":
            bits = bits + F.when(shrunk > limits.doubtful, 1 << at).otherwise(0)
    return hosts.select("host", "n", F.when(bad, -1).otherwise(bits).alias("verdict")), rows


def judge(docs: DataFrame, host: Column | None = None, keep: Column | None = None, limits: Limits = Limits()) -> DataFrame:
    """(keep, host, counts, base_failed, host_verdict, kept): every row of docs with its counts and what follows from them.

    host is `source` unless given, for pages for example host_of(F.col("url")); keep is what identifies the row, doc_id
    unless given. Null texts count as empty, and empty texts fail (fewer than ten words). Rows without a host have no host
    verdict (null) and stay unless a base rule fails. Rows of one id are judged each; repeated rows all count for their
    host. Extra columns are ignored; an empty table gives no rows. Counts are stored once in the shared folder. A host that
    holds a thousandth of the rows or more meets its verdict in a broadcast of 1000 rows at most, all others in a shuffle.
    """
    rows = measured(docs, F.col("source") if host is None else host, F.col("doc_id") if keep is None else keep)
    failed = [rule.cast("bigint").alias(f"f_{name}") for name, rule in rules().items()]
    flat = stored(rows.select("keep", "host", "counts.*"), "measures").select("*", *failed)
    totals = [F.count(F.lit(1)).alias("n"), *(F.sum(f"f_{name}").alias(f"f_{name}") for name in rules())]
    verdicts, n = host_verdicts(flat.filter(F.col("host").isNotNull()).groupBy("host").agg(*totals), limits)
    joined = join_by_share(flat, verdicts, "host", n)
    soft = sum((F.col(f"f_{name}") * (1 << at) for at, name in enumerate(rules()) if name != "base"), F.lit(0))
    vouched = F.col("verdict").isNull() | ((F.col("verdict") >= 0) & (F.col("verdict").bitwiseAND(soft) == 0))
    return joined.select(
        "keep",
        "host",
        F.struct(*MEASURES).alias("counts"),
        (F.col("f_base") > 0).alias("base_failed"),
        F.col("verdict").alias("host_verdict"),
        ((F.col("f_base") == 0) & vouched).alias("kept"),
    )


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without "www.", user and port; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"^www\.|\.$", ""), F.lit(""))


def keep_documents(docs: DataFrame, host: Column | None = None, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
    return judge(docs, host, whole, limits).filter("kept").select("keep.*")


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, the counts, base_failed, kept; n_lines and host_verdict after them."""
    counts = [F.col(f"counts.{name}").alias(name) for name in MEASURES]
    return judge(docs).select(F.col("keep").alias("doc_id"), *counts[:-1], "base_failed", "kept", counts[-1], "host_verdict")
