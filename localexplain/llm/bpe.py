r"""Byte-level BPE by backtracking over longest matches.

A greedy longest match is right unless its last two tokens could not have come from merges side by side. Whether two
tokens may be neighbours does not depend on anything else, so it is checked once per pair and remembered; where no
token fits, the encoder takes the last one back and tries the next shorter prefix. Every byte position is given up at
most once, so the time is linear in the piece. Bytes are mapped to Latin-1 characters for the automata: one gives the
greedy cover, which is the answer if all neighbours fit, else one over reversed tokens gives the longest match at every
byte.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

REMEMBERED = 1 << 17  # chunks, words and pairs of tokens that a worker remembers unless told otherwise
MAX_CHUNK = 64  # characters of a remembered chunk
ROWS_PER_BATCH = 256

# Fixed value: white space as in Unicode's White_Space, then other characters. PATTERN's matches never go on from one
# such chunk into the next and don't depend on what lies outside it, so chunks can be encoded one by one.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"


class Encoder:
    """Encodes pieces of bytes by ranks (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        import ahocorasick

        self.ranks, self.remembered = ranks, remembered
        self.tokens = [b""] * (max(ranks.values()) + 1) if ranks else []
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.forward, self.backward = ahocorasick.Automaton(), ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.forward.add_word(token.decode("latin-1"), (rank, len(token)))
            self.backward.add_word(token[::-1].decode("latin-1"), rank)
        self.forward.make_automaton()
        self.backward.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one, None for a single byte."""
        if token not in self.halves:
            text, ranks = self.tokens[token], self.ranks
            pieces = [text[i : i + 1] for i in range(len(text))]
            while len(pieces) > 2:
                best = min((ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])))
                if best[0] >= token:
                    raise ValueError(f"token {token} can't be reached by merges")
                i = best[1]
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            self.halves[token] = (ranks[pieces[0]], ranks[pieces[1]]) if len(pieces) == 2 else None
        return self.halves[token]

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            text = self.tokens[token]
            self.shorter[token] = next((r for n in range(len(text) - 1, 0, -1) if (r := self.ranks.get(text[:n])) is not None), None)
        return self.shorter[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether merges leave these two tokens side by side: undoes merges, latest first, and looks for an earlier one across."""
        known = self.pairs.get((left, right))
        if known is None:
            a, b, limit, known = left, right, len(self.tokens), True
            while True:
                across = self.ranks.get(self.tokens[a] + self.tokens[b])
                if across is not None and across < limit:
                    known = False
                    break
                undo_left, undo_right = self.parts(a), self.parts(b)
                if undo_left is None and undo_right is None:
                    break
                # Undo the later merge. Equal ids: the left one was merged first, so the right one is undone first.
                if undo_right is None or (undo_left is not None and a > b):
                    limit, a = a, undo_left[1]
                else:
                    limit, b = b + 1, undo_right[0]
            if len(self.pairs) >= self.remembered:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def longest(self, piece: bytes) -> list[int]:
        """The longest token that starts at each byte."""
        n = len(piece)
        found = [-1] * n
        for end, rank in self.backward.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if found[at] < 0:  # of the matches that end at a place, the longest comes first
                found[at] = rank
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        cover, at, last = [], 0, None
        for end, (token, size) in self.forward.iter_long(piece.decode("latin-1")):
            if end + 1 - size != at or not (last is None or self.fit(last, token)):
                break
            cover.append(token)
            at, last = end + 1, token
        # Neighbours that all fit make the one right encoding, whichever way it was found.
        return tuple(cover) if at == len(piece) else self.backtrack(piece)

    def backtrack(self, piece: bytes) -> tuple[int, ...]:
        n, tokens, longest = len(piece), self.tokens, self.longest(piece)
        if n and min(longest) < 0:
            raise ValueError("a byte has no token")
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0] if n else None
        while at < n:
            while True:
                end = at + len(tokens[token])
                if open_at[end] and (not out or self.fit(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    break
                token = self.prefix(token)
                if token is None:
                    open_at[at] = 0
                    token = out.pop()
                    at -= len(tokens[token])
                    break
        return tuple(out)

    def word(self, piece: str) -> tuple[int, ...]:
        got = self.words.get(piece)
        if got is None:
            got = self.encode(piece.encode())
            if len(piece) <= MAX_CHUNK:
                if len(self.words) >= self.remembered:
                    self.words.clear()
                self.words[piece] = got
        return got

    def encode_text(self, text: str, chunks, pieces) -> list[int]:
        """chunks and pieces split a text; a chunk's pieces don't depend on the text around it."""
        ids: list[int] = []
        known, extend = self.known, ids.extend
        for chunk in chunks(text):
            got = known.get(chunk)
            if got is None:
                got = self.older.get(chunk)
                if got is None:
                    got = tuple(chain.from_iterable(map(self.word, pieces(chunk))))
                if len(chunk) <= MAX_CHUNK:
                    if len(known) >= self.remembered:  # frequent chunks come back from the older half
                        self.older, self.known = known, {}
                        known = self.known
                    known[chunk] = got
            extend(got)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenize(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: str = CHUNK, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids: each whole text encoded and decoded again.

    ids_sha256 is over decimal ids joined by one space, decoded_sha256 over the decoded bytes, both in lowercase hex. A
    null text is the empty text, which has no ids. One row per row of docs, repeated rows included; extra columns are
    ignored. Texts of any length are encoded whole. `chunk` must cut a text into parts that `pattern` splits independently
    (CHUNK does for the public pattern). \\p{L} and \\p{N} follow the regex library's Unicode version. The ranks (one vocabulary file, of fixed size) go to every executor
    once; a worker remembers at most twice `remembered` chunks and as many words and pairs of tokens, which changes no result.
    An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks})
    field = [("doc_id", docs.schema["doc_id"].dataType.simpleString())]
    kinds = field + [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    kinds += [("ids", "array<int>")] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regex, state = importlib.import_module("regex"), shared.value
        if "encoder" not in state:  # a worker process keeps the broadcast value, so later tasks find it here
            state["encoder"] = Encoder(state["ranks"], remembered)
            state["names"] = [str(i) for i in range(len(state["encoder"].tokens))]
        encoder, name = state["encoder"], state["names"].__getitem__
        chunks, pieces = re.compile(chunk).findall, regex.compile(pattern).findall
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(at, ROWS_PER_BATCH)
                counts, hashes, back, kept = [], [], [], []
                for text in batch.column(1):
                    ids = encoder.encode_text(text.as_py() or "", chunks, pieces)
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(pa.array(ids, pa.int32()))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(back)]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[k for k, _ in kinds])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds))
