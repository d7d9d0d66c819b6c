"""Near-duplicates by SimHash, checked by exact Jaccard similarity of word shingles; bands of MinHash values find the rest.

Texts with equal shingles are one node. Nodes whose SimHash fingerprints differ in up to RADIUS bits are candidates, as in
simhash.py. At a similarity of 0.8 fingerprints differ in 3 to 11 bits, which no ball reaches, so two nodes are candidates as
well if all minima of one of BANDS bands agree, which at that similarity fails in all bands for 3 pairs in 100 000. Four bits of each minimum make a sketch: candidates whose sketches
differ in more places than one pair in a million at that similarity are no pairs, which is seen where they meet, before any
text is moved. Only nodes, bands and sketches are stored, some 250 bytes a text; the texts of what is left are read once more
and compared in blocks.

Every node is compared first with that node of its bands which meets most others: around a text with many edited copies that
is one of the least edited, which most of the others are near to, so large groups are joined without their pairs. What is
left in a band of up to ALL_PAIRS nodes is compared pair by pair. Nodes of larger bands, texts around common boilerplate as
a rule, are compared by their rarest shingles: of a pair with a Jaccard similarity of a / b or more, the rarest
(1 - a / b) |set| + 1 of the larger set and the rarest (b - a) / (b + a) |set| + 1 of the smaller one have one in common,
whatever the order of rareness is, so none is lost. A pair comes out at the rarest of these only, and if WIDE times 64 one-bit
minima say that it may be as similar: they are made for these nodes alone and rule out nearly all pairs below 0.7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localexplain.llm.common import forget, join_by_share, settled
from localexplain.llm.components import components
from localexplain.llm.simhash import ball_links, fingerprint, shingle_hashes

BANDS = 20
ROWS = 4  # minima of a band
PART = 1 << 14
ALL_PAIRS = 64
SALTS = 8  # tasks that share the nodes of a band
BLOCK = 256  # nodes that one task compares with one other at a time
KEY = ["k1", "k2"]
SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 16)]  # 16 times four bits in each
WIDE = [f"w{i}" for i in range(24)]  # 64 times one bit in each
RADIUS = 2
Share = tuple[int, int]


def minima(hashes: np.ndarray, seed: int, n: int = BANDS * ROWS) -> np.ndarray:
    """The n smallest values of differently mixed hashes."""
    pick = np.random.default_rng(seed)
    odd, add = (pick.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    part = max(1, PART * BANDS * ROWS // n)
    for at in range(0, len(hashes), part):
        mixed = hashes[at : at + part, None] * (odd * np.uint64(2) + np.uint64(1)) + add
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        np.minimum(out, mixed.min(0), out=out)
    return out


def shingle_set(text: bytes | None, words_per_shingle: int, seed: int) -> np.ndarray:
    """The different shingle hashes of a text in order; without words the set is {0}."""
    return set_of(shingle_hashes(text or b"", words_per_shingle, seed))


def set_of(hashes: np.ndarray) -> np.ndarray:
    found = np.unique(hashes)
    return found if len(found) else np.zeros(1, np.uint64)


def wide_sketch(found: np.ndarray, seed: int) -> np.ndarray:
    """The lowest bits of 64 * len(WIDE) further minima of a set."""
    bits = (minima(found, seed + 1, 64 * len(WIDE)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): 96 bits that stand for a row's doc_id and text; equal rows have equal keys."""
    text = F.col("text").cast("binary")
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.hash(text, "doc_id").alias("k2"))


def signatures(rows: DataFrame, words_per_shingle: int, seed: int) -> DataFrame:
    """(doc_id, k1, k2, node, size, fp, bands, sketch columns): node is a hash of the set of shingles, size their number.

    fp is the SimHash fingerprint of all shingles, repeats included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, sizes, prints, bands, sketches = [], [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py() or b"", words_per_shingle, seed)
                found = set_of(hashes)
                prints.append(fingerprint(hashes))
                least = minima(found, seed).reshape(BANDS, ROWS)
                sketches.append(((least.reshape(-1, 16) & np.uint64(15)) << np.arange(0, 64, 4, dtype=np.uint64)).sum(1, dtype=np.uint64))
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), seed))
                sizes.append(len(found))
                bands.append(np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least)], np.uint64).view(np.int64))
            parts = np.array(sketches, np.uint64).reshape(-1, len(SKETCH)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *KEY)), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                 pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(c.copy()) for c in parts.T)],
                names=["doc_id", *KEY, "node", "size", "fp", "bands", *SKETCH],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 bigint, k2 int, node bigint, size bigint, fp bigint, bands array<bigint>"
    schema += "".join(f", {c} bigint" for c in SKETCH)
    return rows.select("doc_id", *KEY, "text").mapInArrow(run, schema)


def texts_of(rows: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one text for each of the given nodes. Equal rows are put together before they are moved."""
    key = F.min(F.struct(*KEY)).alias("key")
    chosen = found.join(nodes, "node", "left_semi").groupBy("node").agg(key).select("node", "key.*")
    return rows.groupBy(*KEY).agg(F.first("text").alias("text")).join(chosen, KEY).select("node", "text")


def alike(pairs: DataFrame, texts: DataFrame, least: Share, words_per_shingle: int, seed: int) -> DataFrame:
    """Of distinct pairs (u, v) of nodes those whose shingles have a Jaccard similarity of at least least[0] / least[1].

    A task holds the set of v and reads up to BLOCK texts of its u one after another; a v with more of them is on several
    tasks. Counts are compared in whole numbers.
    """
    counts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    numbered = pairs.join(counts, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts"))).select("u", "v", "part")
    asked = numbered.join(texts.withColumnRenamed("node", "u"), "u").select("v", "part", F.lit(1).alias("tag"), "u", "text")
    held = numbered.select("v", "part").distinct().join(texts.withColumnRenamed("node", "v"), "v")
    held = held.select("v", "part", F.lit(0).alias("tag"), F.lit(None).cast("bigint").alias("u"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for v, tag, u, text in zip(*(batch.column(c) for c in ("v", "tag", "u", "text"))):
                found = shingle_set(text.as_py(), words_per_shingle, seed)
                if tag.as_py() == 0:
                    mine = found
                    continue
                shared = len(np.intersect1d(mine, found, assume_unique=True))
                if shared * least[1] >= least[0] * (len(mine) + len(found) - shared):
                    us.append(u.as_py())
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    ordered = held.unionByName(asked).repartition("v", "part").sortWithinPartitions("v", "part", "tag")
    return ordered.select("v", "tag", "u", "text").mapInArrow(run, "u bigint, v bigint")


def by_rarest(nodes: DataFrame, texts: DataFrame, least: Share, words_per_shingle: int, seed: int) -> DataFrame:
    """Pairs (u, v), u > v, of the given (node, root, size) with different roots that share a rare shingle, each pair once.

    Holds every pair with a similarity of least or more. Shingles that only one of the nodes has count as the rarest and
    lead to no pair, so a text whose own words are a fifth of it is compared with nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("node"), batch.column("text")):
                found = shingle_set(text.as_py(), words_per_shingle, seed)
                wide = (pa.array([w], pa.int64()) for w in wide_sketch(found, seed).tolist())
                cells = pa.array([found.view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), cells, *wide], names=["node", "shingles", *WIDE])

    schema = "node bigint, shingles array<bigint>" + "".join(f", {c} bigint" for c in WIDE)
    held = settled(texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(run, schema), "rare-cells")
    cells = held.select("node", F.explode("shingles").alias("shingle"))
    common = cells.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = join_by_share(cells, common.withColumn("often", F.col("n")), "shingle", cells.count()).filter("often > 1")
    order = Window.partitionBy("node").orderBy("often", "shingle")
    ranked = several.withColumn("at", F.row_number().over(order)).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("node")))
    a, b = least
    # The larger set of a pair shows (1 - a / b) of its shingles, the smaller one (b - a) / (b + a): that many can't all miss.
    shown = F.floor((b - a) * F.col("size") / b) + 1
    kept_back = F.floor((b - a) * F.col("size") / (a + b)) + 1
    place = F.col("at") + F.col("size") - F.col("shared")
    kept = ranked.join(nodes.select("node", "size"), "node").filter(place <= shown)
    listed = F.sort_array(F.collect_list(F.struct("at", "shingle", (place <= kept_back).alias("early"))))  # a part of one text
    lists = kept.groupBy("node").agg(listed.alias("listed")).join(nodes.select("node", "root", "size"), "node")
    rare = settled(lists.join(held.select("node", *WIDE), "node"), "rarest")
    shingles = F.transform("listed", lambda x: x["shingle"])
    first = F.transform(F.filter("listed", lambda x: x["early"]), lambda x: x["shingle"])
    larger = rare.select(
        F.col("node").alias("u"), *(F.col(c).alias(f"u_{c}") for c in ("root", "size", *WIDE)), shingles.alias("u_list"), F.explode(shingles).alias("shingle")
    )
    smaller = rare.select("node", "root", "size", *WIDE, first.alias("list"), F.explode(first).alias("shingle"))
    above = (F.col("u_size") > F.col("size")) | ((F.col("u_size") == F.col("size")) & (F.col("u") > F.col("node")))
    rarest = F.get(F.array_intersect("u_list", "list"), F.lit(0)) == F.col("shingle")  # both are in order of rareness
    met = larger.join(smaller, "shingle").filter(
        above & (F.col("u_root") != F.col("root")) & sizes_fit("u_", "", least) & wide_fit("u_", "", least) & rarest
    )
    return met.select(F.greatest("u", "node").alias("u"), F.least("u", "node").alias("v"))


def most_of(places: int, miss: float) -> int:
    """In how many of its places a sketch may differ; at least's own similarity one pair in a million differs in more."""
    return math.ceil(places * miss + 5.4 * math.sqrt(places * miss * (1 - miss)))


def sizes_fit(a: str, b: str, least: Share) -> Column:
    size = (F.col(f"{a}size"), F.col(f"{b}size"))
    return F.least(*size) * least[1] >= F.greatest(*size) * least[0]


def wide_fit(a: str, b: str, least: Share) -> Column:
    """Whether two sets can be as similar, by their wide sketches."""
    different = F.lit(0)
    for c in WIDE:
        different = different + F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
    return different <= most_of(64 * len(WIDE), (1 - least[0] / least[1]) / 2)


def fits(a: str, b: str, least: Share) -> Column:
    """Whether two sets can be as similar at all, by their sizes and sketches; a and b are the prefixes of their columns."""
    most = most_of(16 * len(SKETCH), (1 - least[0] / least[1]) * 15 / 16)
    different = F.lit(0)
    for c in SKETCH:
        x = F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))
        low = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        different = different + F.bit_count(low.bitwiseAND(F.lit(0x1111111111111111)))
    return sizes_fit(a, b, least) & (different <= most)


def in_shared_bands(places: DataFrame, several: DataFrame) -> DataFrame:
    """places (node, band) with the columns of their band, as far as several has it.

    The nodes of a band are dealt to SALTS tasks. Only rows of bands that several nodes share come out: nearly all bands
    have one node, and any other way round would pass on their rows first, BANDS of them for each text.
    """
    dealt = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = places.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int"))
    return salted.join(dealt.hint("merge"), ["band", "salt"]).drop("salt", "n")


def near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of the given (node, fp): of nodes with one fingerprint, and of fingerprints within RADIUS bits.

    The smallest node stands for its fingerprint.
    """
    prints = nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("v"))
    equal = join_by_share(nodes, prints.filter("n > 1"), "fp", nodes.count()).filter(F.col("node") > F.col("v"))
    of = prints.select("fp", F.col("v").alias("node"))
    near = ball_links(prints.select("fp"), RADIUS).withColumnsRenamed({"u": "fp", "v": "other"})
    near = near.join(of, "fp").select(F.col("node").alias("a"), F.col("other").alias("fp")).join(of, "fp")
    met = equal.select(F.col("node").alias("u"), "v").unionByName(near.select(F.greatest("a", "node").alias("u"), F.least("a", "node").alias("v")))
    return met.distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, least: Share = (4, 5), seed: int = 42) -> DataFrame:
    """doc_id, k1, k2, component_id, first: every row of docs with the smallest doc_id reachable over links.

    (k1, k2) stand for doc_id and text as in keyed(); first says that the row has the smallest (doc_id, k1, k2) of its
    component. Null and empty texts and texts without words are alike. Rows of one doc_id with different texts are judged
    each; repeated rows come as often as they are. A null doc_id never names a component, unless nothing else is in it.
    Texts are compared whole, whatever their length. Other columns of docs, of any name, are ignored; an empty table gives
    no rows.
    """
    rows = keyed(docs)
    found = settled(signatures(rows, words_per_shingle, seed), "signatures")
    places = found.select("node", F.explode("bands").alias("band")).distinct()
    sketches = settled(found.groupBy("node").agg(F.min("fp").alias("fp"), F.first("size").alias("size"), *(F.first(c).alias(c) for c in SKETCH)), "sketches")

    def of(prefix: str) -> DataFrame:
        """The sketches under other names: the node is the prefix."""
        return sketches.select(F.col("node").alias(prefix), *(F.col(c).alias(f"{prefix}_{c}") for c in ("size", *SKETCH)))

    prints = settled(near_prints(sketches.select("node", "fp")), "prints")
    several = places.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("band_nodes", F.col("n"))
    shared = settled(in_shared_bands(places, several), "bands")
    asked = shared.select("node").unionByName(prints.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    texts = settled(texts_of(rows, found, asked), "candidates")

    def compared(pairs: DataFrame) -> DataFrame:
        return settled(alike(pairs, texts, least, words_per_shingle, seed), "near")

    def rooted(links: DataFrame, table: DataFrame, node: str, root: str) -> DataFrame:
        named = links.select(F.col("node").alias(node), F.col("root").alias(root))
        return table.join(named, node, "left").withColumn(root, F.coalesce(root, node))

    # Every node with the node of each of its bands that meets most others in all its bands.
    v_columns = [f"v_{c}" for c in ("size", *SKETCH)]
    met = shared.groupBy("node").agg(F.sum("band_nodes").alias("met"))
    heads = shared.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node")).alias("head"))
    heads = heads.select("band", F.col("head.node").alias("v")).join(of("v"), "v")
    stars = in_shared_bands(shared, heads).filter(F.col("node") != F.col("v")).groupBy(F.col("node").alias("u"), "v").agg(
        *(F.first(c).alias(c) for c in v_columns)
    )
    stars = stars.join(of("u"), "u").filter(fits("u_", "v_", least)).select("u", "v")
    near = compared(stars.unionByName(prints).distinct())
    roots = components(near, "jaccard")

    # What is left in bands that hold more than one root.
    placed = rooted(roots, shared, "node", "root").select("band", "node", "root", "band_nodes")
    split = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b")
    left = settled(join_by_share(placed, split.withColumn("is_open", F.lit(True)), "band", shared.count()).filter("is_open"), "open-bands")
    few = left.filter(F.col("band_nodes") <= ALL_PAIRS).select("band", "node", "root").join(sketches, "node")
    other = few.select("band", F.col("node").alias("u"), *(F.col(c).alias(f"u_{c}") for c in ("root", "size", *SKETCH)))
    pairs = other.join(few, "band").filter((F.col("u") > F.col("node")) & (F.col("u_root") != F.col("root")) & fits("u_", "", least))
    pairs = pairs.select("u", F.col("node").alias("v"))
    many = left.filter(F.col("band_nodes") > ALL_PAIRS).select("node", "root").distinct()
    many = settled(many.join(sketches.select("node", "size"), "node"), "large-bands")
    if not many.isEmpty():
        pairs = pairs.unionByName(by_rarest(many, texts, least, words_per_shingle, seed))
    # Each group that is known is a star by now: only new links take further rounds.
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    near = known.unionByName(compared(pairs.distinct()))

    ends = components(near, "jaccard")
    named = settled(rooted(ends, found.select("doc_id", *KEY, "node"), "node", "root"), "jaccard-roots")
    for table in (shared, texts, sketches, prints, left, many):
        forget(table)
    unnamed = F.col("doc_id").isNull()
    first = F.min(F.struct(unnamed.alias("unnamed"), "doc_id", *KEY)).alias("first")
    heads = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("component_id"), first)
    whole = join_by_share(named, heads, "root", named.count())
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    return whole.select("doc_id", *KEY, "component_id", mine.alias("first"))


def firsts(docs: DataFrame, words_per_shingle: int = 5, least: Share = (4, 5), seed: int = 42) -> DataFrame:
    """The rows of docs that come first in their group of near-duplicates, each once, with all their columns.

    Rows that repeat a doc_id and a text are one document, of which one row stays. A group's row is found by its doc_id and
    text, so another text under the same doc_id stays if nothing else holds it. See near_duplicates() for odd input.
    """
    found = settled(near_duplicates(docs, words_per_shingle, least, seed), "judged").filter("first")
    once = found.groupBy(*(F.col(c).alias(f"_{c}") for c in KEY)).agg(F.count(F.lit(1)).alias("_n"))
    text = F.col("text").cast("binary")
    here = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row"), "doc_id", "text")
    here = here.select("row", F.xxhash64("doc_id", text).alias("_k1"), F.hash(text, "doc_id").alias("_k2")).join(once, ["_k1", "_k2"])
    repeated = here.filter("_n > 1").groupBy("_k1", "_k2").agg(F.first("row").alias("row"))
    return here.filter("_n = 1").select("row.*").unionAll(repeated.select("row.*"))
