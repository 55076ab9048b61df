"""Byte-level BPE over a public rank file, with a hierarchical-bitmap rank queue.

Pre-tokens stand as linked lists of parts in one array, each list closed by a break, so that one queue serves a single
very long pre-token as well as thousands of short ones. Every pair of neighbours that has a rank waits in the bucket of
that rank. A three-level bitmap of 64-bit words marks the buckets that hold something: find-first-set on the three
levels gives the lowest rank. That bucket is emptied from left to right: entries whose pair has changed since they were
queued are stale and skipped, the others merge, and the new pairs on both sides are queued. As each merge removes one
part, the work is linear in the bytes but for the sorting inside buckets. Tokens that can make a lower-ranked token with
a neighbour are merged one at a time in a piece, because that lower rank comes first.

A null or empty text has no ids and decodes to nothing. Ids of a document are held as one array.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vetloom.llm.shared import bounded_batches, id_and_bytes, steps

#: Different pre-tokens that a worker remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 300_000
#: Bytes of text that are split into pre-tokens at once.
STEP_BYTES = 4 << 20


class RankQueue:
    """Buckets per rank under a hierarchy of bitmaps; ``pop`` empties the lowest bucket."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        sizes = [ranks // 64 + 1]
        while sizes[-1] > 1:
            sizes.append(sizes[-1] // 64 + 1 if sizes[-1] > 64 else 1)
        self.levels = [[0] * s for s in sizes]

    def push(self, rank: int, places: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(places)
            return
        self.buckets[rank] = [places]
        for level in self.levels:
            word, bit = rank >> 6, rank & 63
            before = level[word]
            level[word] = before | 1 << bit
            if before:
                break
            rank = word

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        if len(ranks) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = np.concatenate(([0], cuts)).tolist()
        ends = np.append(cuts, len(ranks)).tolist()
        for rank, a, b in zip(ranks[starts].tolist(), starts, ends):
            self.push(rank, places[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | (word & -word).bit_length() - 1
        held = self.buckets.pop(at)
        rest = at
        for level in self.levels:
            word, bit = rest >> 6, rest & 63
            level[word] &= ~(1 << bit)
            if level[word]:
                break
            rest = word
        return at, (held[0] if len(held) == 1 else np.concatenate(held))


class Vocabulary:
    """Ranks of a file, the pairs of parts that merge, and the bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        pairs, made = np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64)
        order = np.argsort(pairs)
        self.keys = np.append(pairs[order], np.iinfo(np.int64).max)
        self.merged = np.append(made[order], -1)
        #: Ranks whose token makes a lower-ranked token with a neighbour: merges of them go one at a time in a piece.
        self.single_step = np.zeros(self.size, dtype=bool)
        for side in (pairs // self.size, pairs % self.size):
            self.single_step[side[made < side]] = True

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two parts make together; -1 if there is none or a part is a break (-1)."""
        keys = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        found = np.searchsorted(self.keys, keys)
        return np.where(self.keys[found] == keys, self.merged[found], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        whole = [self.ranks.get(p) for p in pieces]
        open_ = [i for i, rank in enumerate(whole) if rank is None and pieces[i]]
        out = [b"" if rank is None else rank.to_bytes(4, "little") for rank in whole]
        if not open_:
            return out
        raw = np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)
        length = np.array([len(pieces[i]) for i in open_], dtype=np.int64)
        start = np.cumsum(length) - length + np.arange(1, len(open_) + 1)  # one break before each piece and one at the end
        part = np.full(len(raw) + len(open_) + 1, -1, dtype=np.int64)
        part[np.arange(len(raw)) + np.repeat(np.arange(1, len(open_) + 1), length)] = self.single[raw]
        n = len(part)
        owner = np.cumsum(part == -1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        queue = RankQueue(self.size)
        first = self.pair_ranks(part[:-1], part[1:])
        at = np.flatnonzero(first >= 0)
        queue.push_all(first[at], at)
        while (item := queue.pop()) is not None:
            rank, places = item
            places = np.unique(places)
            places = places[part[places] >= 0]  # -2: merged into the part on its left
            right = after[places]
            fresh = self.pair_ranks(part[places], part[right]) == rank
            places, right = places[fresh], right[fresh]
            if self.single_step[rank] and len(places) > 1:
                first = np.concatenate(([True], owner[places[1:]] != owner[places[:-1]]))
                if not first.all():
                    queue.push(rank, places[~first])
                places, right = places[first], right[first]
            if len(places) > 1 and (chained := right[:-1] == places[1:]).any():  # aaa: every second pair of a chain
                heads = np.flatnonzero(np.concatenate(([True], ~chained)))
                turn = np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))
                places, right = places[turn % 2 == 0], right[turn % 2 == 0]
            if not len(places):
                continue
            part[places], part[right] = rank, -2
            beyond = after[right]
            after[places], before[beyond] = beyond, places
            sides = np.concatenate((before[places], places))
            ranks = self.pair_ranks(part[sides], part[after[sides]])
            live = ranks >= 0
            queue.push_all(ranks[live], sides[live])
        ids = part.astype("<u4")
        kept = part >= 0
        bounds = np.cumsum(kept)
        ends = bounds[np.append(start[1:] - 1, n - 1)]
        packed = ids[kept].tobytes()
        a = 0
        for i, b in zip(open_, ends.tolist()):
            out[i] = packed[4 * a : 4 * b]
            a = b
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _vocabulary(share: Broadcast) -> tuple[Vocabulary, dict[str, bytes]]:
    return Vocabulary(share.value), {}


def encode_texts(texts: list[str], pattern: regex.Pattern, vocabulary: Vocabulary, known: dict[str, bytes]) -> list[bytes]:
    """Packed ids of each text; ``known`` remembers pre-tokens from one call to the next."""
    if len(known) > REMEMBERED:
        known.clear()
    split = [pattern.findall(t) for t in texts]
    fresh = list({p for pieces in split for p in pieces} - known.keys())
    known.update(zip(fresh, vocabulary.encode_pieces([p.encode() for p in fresh])))
    get = known.__getitem__
    return [b"".join(map(get, pieces)) for pieces in split]


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, read once by the driver; its size is that of the vocabulary, whatever the corpus."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of integers) of every row."""
    bounded_batches(docs.sparkSession)
    rows, share = id_and_bytes(docs, id_col, text_col), share_ranks(docs.sparkSession, path)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = _vocabulary(share)
        compiled = regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = encode_texts([d.as_py().decode("utf-8", "replace") for d in part.column(1)], compiled, vocabulary, known)
                ids = pa.array([np.frombuffer(f, "<u4").astype(np.int32) for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, data`` (the bytes) of every row of ids; null ids decode to nothing."""
    share = share_ranks(encoded.sparkSession, path)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = _vocabulary(share)
        for batch in batches:
            out = [vocabulary.decode(ids.values.to_numpy()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "data"])

    return rows.mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of the ids of every row, and the digest of what they decode to, in one pass over the texts."""
    bounded_batches(docs.sparkSession)
    rows, share = id_and_bytes(docs, id_col, text_col), share_ranks(docs.sparkSession, path)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = _vocabulary(share)
        compiled = regex.compile(pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for ids, texts in steps(batches, STEP_BYTES):
            found = encode_texts([t.decode("utf-8", "replace") for t in texts], compiled, vocabulary, known)
            back = [sha(vocabulary.decode(np.frombuffer(f, "<u4"))) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, to_arrow_type(kind)), pa.array([len(f) // 4 for f in found], pa.int64()),
                    pa.array(map(sha, found), pa.string()), pa.array(back, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
