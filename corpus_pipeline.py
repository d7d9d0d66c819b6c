"""A training corpus from raw documents: toxicity, near-duplicates, repeated passages, mixing of sources, tokens.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and returns a DataFrame; all but the last
return the columns of docs. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from localexplain.llm import bpe, jaccard, mixing, suffix_dedup, toxicity
from localexplain.llm.common import forget, read, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from the labels of the documents given.

    Null texts are scored as empty ones. Rows without a doc_id have no label and are judged like all others.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more) that with the smallest doc_id.

    Candidates come from SimHash fingerprints, as in op2, and from MinHash bands for the pairs that fingerprints hold further
    apart; all are checked by their exact similarity.
    A row is known by doc_id and text: what repeats both stays once, another text under the same doc_id is another document.
    Rows without an id come last in their group; null texts and texts without words are alike.
    """
    return jaccard.firsts(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that an earlier document has; n_chars follows.

    Where a cut goes through a character, its remaining bytes go too. Documents stay, even where no text is left.
    """
    return suffix_dedup.cut_texts(docs).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, twice at most; null sources are a source, null texts have no words."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row; a null text has no tokens."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.tokenize(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("suffix_array_dedup", without_repeats),
    ("mixing_sources", mixed_sources),
    ("byte_level_bpe", tokens),
]

# Training, SimHash and MinHash of the first two stages can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)  # no later stage reads it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
