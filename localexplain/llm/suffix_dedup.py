"""Removal of repeated byte strings by sorting suffixes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

1. Exact copies are told apart by digest: only the copy with the smallest id needs comparing, others go whole.
2. Every window of `length` bytes has a smallest hash of the GRAM-byte strings in it. Equal windows have equal smallest
   hashes, so windows meet in the group of that hash. Stretches of windows with one smallest hash are called runs; only
   runs whose hash occurs in two documents are cut out and sent to their group.
3. A group's suffixes are put in order by a mergesort that compares by hash: prefix polynomial hashes and a binary search
   find how far two suffixes agree. Neighbours that agree over the whole length are one class. The order is checked
   against the bytes, and made again with another base if hashes collided. A group of more than GROUP_BYTES is passed on
   row by row instead: its windows are grouped by their bytes in Spark, so no task holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from localexplain.llm.common import forget, stored

GRAM = 20  # long enough that unrelated texts seldom share one, short enough for runs of many windows
BATCH_BYTES = 1 << 18  # text of groups that are sorted together: its hashes stay in the processor's cache
GROUP_BYTES = 1 << 22  # text of one group that a task holds at most
CUT_BYTES = 1 << 21
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
TEXT_PART = 1 << 22
SALTS = 16


class Collision(Exception):
    """Comparisons by hash contradict each other."""


class Suffixes:
    """Prefix hashes of a buffer, and comparisons of its suffixes up to `length` bytes."""

    def __init__(self, buffer: np.ndarray, length: int, base: int):
        self.buffer, self.length = buffer, length
        steps = [1 << k for k in range(length.bit_length() - 1, -1, -1)]
        self.steps = steps
        ones = np.full(len(buffer) + 1, base, np.uint64)
        ones[0] = 1
        power = np.cumprod(ones)
        ones[1:] = pow(base, -1, 1 << 64)
        self.back = np.cumprod(ones)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[:-1])))

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, `length` at most: a binary search over hashes."""
        far = np.zeros(len(a), np.int64)
        for step in self.steps:
            fits = np.flatnonzero(far + step <= self.length)
            same = self.hashes(a[fits] + far[fits], step) == self.hashes(b[fits] + far[fits], step)
            far[fits[same]] += step
        return far

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before the one at b (equal ones: not)."""
        far = self.common(a, b)
        ends = far >= self.length
        far = np.where(ends, 0, far)
        return ~ends & (self.buffer[a + far] < self.buffer[b + far])

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """starts in order of their suffixes: a bottom-up mergesort that merges all pairs of a level at once, stable."""
        order, n, width = starts.copy(), len(starts), 1
        place = np.arange(n)
        # Most suffixes differ in their first eight bytes; only those that don't are compared by hash.
        first_bytes = np.ndarray((len(self.buffer) - 7,), ">u8", self.buffer, strides=(1,))[starts].astype(np.uint64)
        while width < n:
            block = place // width
            left = block % 2 == 0
            other = np.where(left, (block + 1) * width, (block - 1) * width)
            low = np.minimum(other, n)
            first, high = low.copy(), np.minimum(other + width, n)
            while len(todo := np.flatnonzero(low < high)):
                middle = (low[todo] + high[todo]) // 2
                # From the left: behind those that come before it. From the right: also behind its equals.
                mine, theirs = first_bytes[todo], first_bytes[middle]
                passed = theirs < mine
                if len(same := np.flatnonzero(theirs == mine)):
                    is_left, a, b = left[todo[same]], order[todo[same]], order[middle[same]]
                    earlier = self.before(np.where(is_left, b, a), np.where(is_left, a, b))
                    passed[same] = np.where(is_left, earlier, ~earlier)
                low[todo[passed]] = middle[passed] + 1
                high[todo[~passed]] = middle[~passed]
            target = (block - block % 2) * width + (place - block * width) + (low - first)
            if (np.bincount(target, minlength=n) != 1).any():
                raise Collision
            merged, keys = np.empty_like(order), np.empty_like(first_bytes)
            merged[target], keys[target] = order, first_bytes
            order, first_bytes, width = merged, keys, width * 2
        return order


def classes(buffer: np.ndarray, starts: np.ndarray, length: int, bases: tuple[int, ...] = BASES) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): indices into starts in suffix order, and where another string begins. Right whatever hashes do."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, bool)
    index = np.empty(len(buffer), np.int64)
    index[starts] = np.arange(len(starts))
    windows = np.lib.stride_tricks.sliding_window_view(buffer, length)
    for base in bases:
        suffixes = Suffixes(buffer, length, base)
        try:
            order = suffixes.sort(starts)
        except Collision:
            continue
        far = suffixes.common(order[:-1], order[1:])
        new = np.concatenate(([True], far < length))
        if _verified(windows, order, new):
            return index[order], new
    order = np.lexsort(windows[starts].T[::-1])  # three bases collided: compare all bytes
    rows = windows[starts[order]]
    return order, np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))


def _verified(windows: np.ndarray, order: np.ndarray, new: np.ndarray, part: int = 1 << 14) -> bool:
    """Whether the windows really stand in order and `new` marks exactly the changes."""
    for at in range(0, len(order) - 1, part):
        rows = windows[order[at : at + part + 1]]
        differ = rows[1:] != rows[:-1]
        where = differ.argmax(1)
        changed = differ.any(1)
        k = np.arange(len(where))
        if (changed != new[at + 1 : at + 1 + len(where)]).any() or (rows[1:][k, where] < rows[:-1][k, where]).any():
            return False
    return True


def smallest_hashes(text: bytes, length: int) -> np.ndarray:
    """For every window of the text the smallest hash of the GRAM-byte strings in it."""
    n = len(text)
    if n < length:
        return np.empty(0, np.uint64)
    eight, count = np.ndarray((n - 7,), "<u8", text, strides=(1,)), n - GRAM + 1
    h = np.zeros(count, np.uint64)
    for at, odd in zip([*range(0, GRAM - 8, 8), GRAM - 8], BASES):
        h += eight[at : at + count] * np.uint64(odd)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    wanted, have = length - GRAM + 1, 1
    while have * 2 <= wanted:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (wanted - have)], h[wanted - have :]) if have < wanted else h


def runs(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first window, windows) of the runs of a text, part by part for very long ones."""
    for at in range(0, max(len(text) - length + 1, 0), TEXT_PART):
        part = text[at : at + TEXT_PART + length - 1] if len(text) > TEXT_PART else text
        h = smallest_hashes(part, length)
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        yield h[first], first + at, np.diff(np.append(first, len(h)))


def _hashes_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            found = [np.unique(np.concatenate([np.empty(0, np.uint64), *(h for h, _, _ in runs(t.as_py(), length))])) for t in some.column(1)]
            ids = pa.array(np.repeat(np.arange(some.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), some.column(0).take(ids)], names=["h", "doc_id"]
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (h, doc_id) those whose h has two documents. Holds back one row."""
    held_h, held_d, shared = None, None, False
    for batch in batches:
        h, d = (c.to_numpy() for c in batch.columns)
        if not len(h):
            continue
        known = shared and h[0] == held_h
        if not shared and held_h is not None:
            h, d = np.concatenate(([held_h], h)), np.concatenate(([held_d], d))
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.append(first, len(h)))
        several = d[first] != d[first + sizes - 1]
        several[0] |= known
        out = np.repeat(several, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(d[out])], names=["h", "doc_id"])
        held_h, held_d, shared = h[-1], d[-1], bool(several[-1])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, tag, shared hashes) the runs that have one of the hashes."""
    for batch in batches:
        hashes, ids, tags, places, texts, size = [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.binary())],
                names=["h", "doc_id", "tag", "place", "run"],
            )

        for doc, text, tag, wanted in zip(*batch.columns):
            raw, keys = text.as_py(), np.sort(wanted.values.to_numpy())
            for h, first, n in runs(raw, length):
                h = h.view(np.int64)
                hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
                for key, a, k in zip(h[hit].tolist(), first[hit].tolist(), n[hit].tolist()):
                    hashes.append(key)
                    places.append(a)
                    texts.append(raw[a : a + k + length - 1])
                    size += k + length
                got = int(hit.sum())
                ids.extend([doc.as_py()] * got)
                tags.extend([tag.as_py()] * got)
            if size > CUT_BYTES:
                yield out()
                hashes, ids, tags, places, texts, size = [], [], [], [], [], 0
        if hashes:
            yield out()


def repeats(rows: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int, int]]:
    """(doc_id, tag, start, end) of the stretches to remove, from (doc_id, tag, place, run) of whole groups."""
    found, least = [], {}
    for doc, _, _, run in rows:
        if run not in least or doc < least[run]:
            least[run] = doc
    fresh, seen = [], set()
    for doc, tag, place, run in rows:
        if doc > least[run]:  # the whole run starts in a smaller document, window by window
            found.append((doc, tag, place, place + len(run)))
        else:
            fresh.append((doc, tag, place, run))
            seen.add(run)
    if len(seen) < 2:
        return found
    buffer = np.frombuffer(b"".join(r[3] for r in fresh), np.uint8)
    sizes = np.array([len(r[3]) for r in fresh])
    begins = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(fresh)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begins[owner] + inside
    # Equal strings have equal hashes: a hash that occurs once is a string that occurs once, and needs no place in the order.
    whole = Suffixes(buffer, length, BASES[0]).hashes(starts, length)
    _, which, often = np.unique(whole, return_inverse=True, return_counts=True)
    may = np.flatnonzero(often[which] > 1)
    docs = np.array([r[0] for r in fresh], np.int64)
    order, new = classes(buffer, starts[may], length)
    if not len(order):
        return found
    doc_of = docs[owner[may[order]]]
    label = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(doc_of, np.flatnonzero(new))
    gone = np.sort(may[order[doc_of > smallest[label]]])
    if len(gone):
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(gone) > 1) | (np.diff(owner[gone]) > 0))))
        last = np.append(edge[1:], len(gone)) - 1
        for a, b in zip(gone[edge].tolist(), gone[last].tolist()):
            doc, tag, place, _ = fresh[owner[a]]
            found.append((doc, tag, int(place + inside[a]), int(place + inside[b] + length)))
    return found


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int, group_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc_id, tag, place, run) in order of h: whole groups, many small ones at a time. Gives stretches to remove
    (run null), and the rows of groups over group_bytes as they are (end null)."""
    rows: list = []
    passed: list = []
    size, last, begin, own, held, large = 0, None, 0, 0, 0, False

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "tag", "start", "end", "run"])

    def marks() -> pa.RecordBatch:
        return out([(*r, None) for r in repeats(rows, length)])

    for batch in batches:
        for h, doc, tag, place, run in zip(*batch.columns):
            h, row = h.as_py(), (doc.as_py(), tag.as_py(), place.as_py(), run.as_py())
            if h != last:
                if size > BATCH_BYTES:
                    yield marks()
                    rows, size = [], 0
                last, begin, own, large = h, len(rows), 0, False
            if not large:
                rows.append(row)
                own += len(row[3])
                size += len(row[3])
                if own > group_bytes:
                    large, size, held = True, size - own, held + own
                    passed += [(d, t, a, None, r) for d, t, a, r in rows[begin:]]
                    del rows[begin:]
            else:
                passed.append((*row[:3], None, row[3]))
                held += len(row[3])
            if held > CUT_BYTES:
                yield out(passed)
                passed, held = [], 0
    if passed:
        yield out(passed)
    if rows:
        yield marks()


def _by_window(large: DataFrame, length: int) -> DataFrame:
    """Stretches to remove, from the rows of groups that no task should hold: every window's smallest document, by partial
    aggregation, joined back to its places in SALTS parts."""
    at = F.explode(F.sequence(F.lit(0), F.length("run") - length))
    windows = large.select("doc_id", "tag", "start", "run", at.alias("at"))
    windows = windows.select("doc_id", "tag", (F.col("start") + F.col("at")).alias("start"), F.substring("run", F.col("at") + 1, F.lit(length)).alias("window"))
    least = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    least = least.select("window", "least", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    gone = dealt.join(least, ["window", "salt"]).filter("doc_id > least")
    return gone.select("doc_id", "tag", "start", (F.col("start") + length).alias("end"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _tag(text: Column) -> Column:
    """Tells the texts of one document id apart, should there be several: 32 bits, as it travels with every run."""
    return F.shiftrightunsigned(F.xxhash64(text), 32)


def repeated_spans(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, text (binary), spans: array<struct<start, end>> of maximal runs of bytes to remove, in order; and kept, a
    struct k0, k1, .. of the columns that `keep` names.

    One row per row of docs. A null text is the empty text. Texts under `length` bytes stay whole. Rows that share a
    doc_id never take from each other, repeated rows get equal results; a null doc_id is not smaller than any id and none
    is smaller than it, so such rows stay whole and take nothing. Matches never cross documents; a document may repeat
    itself freely. Extra columns are ignored. doc_id is a whole number.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings need at least {2 * GRAM} bytes")
    kept = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep))) if keep else F.lit(True)
    named = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), kept.alias("kept")
    )
    whole = named.filter(F.col("doc_id").isNotNull())
    # One exchange of the texts, by document, serves all three joins below: nothing above it may push a filter into one.
    dealt = whole.repartition("doc_id")
    tagged = dealt.withColumn("tag", _tag(F.col("text")))
    digest = stored(
        whole.filter(F.length("text") >= length).select("doc_id", F.unhex(F.md5("text")).alias("digest"), _tag(F.col("text")).alias("tag")),
        "digests",
    )
    least = digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    copies = digest.join(least, "digest").filter("doc_id > least").groupBy("doc_id").agg(F.collect_set("tag").alias("copied"))
    copies = stored(copies, "copies")
    forget(digest)
    is_copy = F.coalesce(F.array_contains("copied", F.col("tag")), F.lit(False))
    with_copies = tagged.join(copies, "doc_id", "left")
    own = with_copies.filter(~is_copy)

    pairs = own.select("doc_id", "text").mapInArrow(lambda b: _hashes_of(b, length), "h bigint, doc_id bigint")
    met = pairs.repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(_met, "h bigint, doc_id bigint")
    lists = met.groupBy("doc_id").agg(F.collect_list("h").alias("shared"))
    cut = (
        own.join(lists, "doc_id")
        .select("doc_id", "text", "tag", "shared")
        .mapInArrow(lambda b: _cut(b, length), "h bigint, doc_id bigint, tag bigint, place bigint, run binary")
    )
    marks = (
        cut.repartition("h").sortWithinPartitions("h", "doc_id")
        .mapInArrow(lambda b: _sorted_groups(b, length, group_bytes), "doc_id bigint, tag bigint, start bigint, end bigint, run binary")
    )
    marks = stored(marks, "marks")
    large = marks.filter(F.col("run").isNotNull())
    marks = marks.filter(F.col("run").isNull()).drop("run").unionByName(_by_window(large, length))
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "end")).alias("marks"))
    found = with_copies.join(marks, "doc_id", "left")
    found = found.select("doc_id", "text", "tag", is_copy.alias("copy"), "marks", "kept")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for text, tag, copy, own_marks in zip(*batch.columns[1:5]):
                if copy.as_py():
                    got = [(0, len(text.as_buffer()))]
                else:
                    got = merged([(m["start"], m["end"]) for m in own_marks.as_py() or () if m["tag"] == tag.as_py()])
                spans.append([{"start": a, "end": b} for a, b in got])
            columns = [batch.column(0), batch.column(1), pa.array(spans, kind), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "spans", "kept"])

    schema = "doc_id bigint, text binary, spans array<struct<start: bigint, end: bigint>>, kept "
    schema += named.schema["kept"].dataType.simpleString()
    nameless = named.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"), "kept")
    return found.mapInArrow(settle, schema).unionByName(nameless)


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes outside the spans, one after the other."""
    edges = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))), spans)
    last = F.struct(F.length(text).cast("bigint").alias("start"), F.length(text).cast("bigint").alias("end"))
    gaps = F.arrays_zip(edges["end"].alias("a"), F.concat(spans["start"], F.array(last["start"])).alias("b"))
    pieces = F.transform(gaps, lambda g: F.hex(F.substr(text, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))
    return F.unhex(F.array_join(pieces, ""))


def remove_repeats(docs: DataFrame, length: int = 50, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): repeated_spans() applied."""
    found = repeated_spans(docs, length, group_bytes=group_bytes)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.when(F.size("spans") == 0, F.col("text")).otherwise(kept_bytes(F.col("text"), F.col("spans"))).alias("kept"),
    )


def cut_texts(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of docs with repeated_spans() cut out of text, and n_chars (if there) of the new text.

    A cut may split a character; the bytes that are left of it are dropped. Rows without cuts keep their text, null too.
    Rows without a doc_id are not cut. Columns may have any name; an empty table stays empty.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    null = "text is null"
    while null in docs.columns:
        null += "?"
    found = repeated_spans(docs.withColumn(null, F.col("text").isNull()), length, (*rest, null))
    names = ["c0", *(f"c{i + 1}" for i in range(len(rest)))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans, was_null in zip(*batch.columns[-3:]):
                raw, at, pieces = text.as_py(), 0, []
                for s in spans.as_py():
                    pieces.append(raw[at : s["start"]])
                    at = s["end"]
                texts.append(None if was_null.as_py() else b"".join([*pieces, raw[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(texts, pa.string())], names=[*names, "cut"])

    kinds = ["c0 bigint", *(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names[1:], rest))]
    chosen = found.select(
        F.col("doc_id").alias("c0"),
        *(F.col(f"kept.k{i}").alias(n) for i, n in enumerate(names[1:])),
        "text",
        "spans",
        F.col(f"kept.k{len(rest)}").alias("was_null"),
    )
    place = {"doc_id": F.col("c0"), "text": F.col("cut"), **{c: F.col(n) for c, n in zip(rest, names[1:])}}
    if "n_chars" in place:
        place["n_chars"] = F.length("cut")
    done = chosen.mapInArrow(cut, ", ".join([*kinds, "cut string"]))
    return done.select(*(place[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
