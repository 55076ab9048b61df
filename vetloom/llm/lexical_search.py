"""Ranked lexical search over bit-sliced Bloom signatures, exact.

The index. Every document gets a Bloom signature of its terms. A term that occurs ``tf`` times puts in one key for each of
the levels 1, 2, 4, 8, … up to ``tf``, so a signature also bounds counts. Documents of about as many keys stand together in
blocks, and a block is stored slice by slice: one bitmap over its documents per signature bit. A dictionary holds every
term with the number of its documents.

A search. The bitmap of a term and level is the conjunction of its slices: it has all documents that hold the term so
often, and few others. Summed with the terms' weights, level by level, the bitmaps give an upper bound of every document's
score. A few times ``k`` documents of the largest bounds are scored exactly; the ``k``-th best of those scores is a floor of
the answer. Then all documents whose bound reaches the floor are scored exactly, from their whole texts, and the ``k`` best stay. A document
is left out only if its bound proves that it can't be among them.

Queries are searched in blocks of bounded size; each block is two passes over the index, which is about a fifth
of the corpus. Equal texts (128 bits of hash) are scored once, and each text sends at most ``k`` of its rows, those of the smallest
ids, into the final order, so a text that a third of all rows share costs as much as any other.

A null or empty text has no terms: it counts nowhere and is never found. Repeated rows count each, and each is a result.
Equal scores are ordered by id, a null id last. Repeated queries are answered each. Without documents or queries there are
no results. Very long texts make blocks of eight documents at least. Other columns are never read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetloom.llm.shared import bounded_batches, cut, stored
from vetloom.session import checkpoint_dir

#: ASCII letters and digits and all other bytes from 0x80 on are parts of terms, A-Z as a-z; the rest are blanks.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
BITS_PER_KEY = 12
HASHES = 6
#: Bits of a block while it is made (one byte each), and documents of a block.
BLOCK_BITS = 1 << 23
BLOCK_DOCS = 1024
#: Terms that a task counts before it passes the counts on.
COUNTED = 400_000
#: Documents scored for the floor, in multiples of ``k``: short texts have large bounds by chance, some of the best fall away.
FLOOR_TIMES = 4
#: Queries, and their terms, that one pass over the index takes.
PASS_QUERIES = 2_000
PASS_TERMS = 200_000
INDEX = "term binary, df long, docs long, words long, bits int, t1 binary, t2 binary, lengths binary, slices binary"


def terms(data: bytes) -> Counter:
    """How often each term occurs."""
    return Counter(data.translate(FOLD).split())


def positions(hashes: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """``HASHES`` signature bits of each term hash at a level, by double hashing."""
    x = hashes + np.asarray(level, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return (((x & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _signature_keys(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hash and level of each key of a document."""
    n = len(counts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, n)
    levels = np.fromiter((c.bit_length() for c in counts.values()), np.int64, n)
    own = np.repeat(np.arange(n), levels)
    return hashes[own], np.arange(len(own)) - np.repeat(np.cumsum(levels) - levels, levels)


def _block(held: list[tuple], bits: int) -> dict:
    """One row of the index from ``(t1, t2, length, hashes, levels)`` of its documents."""
    width = (len(held) + 7) // 8 * 8
    matrix = np.zeros((bits, width), dtype=np.uint8)
    for column, (_, _, _, hashes, levels) in enumerate(held):
        matrix[positions(hashes, levels, bits), column] = 1
    lengths = np.array([h[2] for h in held], dtype=np.int64)
    return {
        "docs": len(held), "words": int(lengths.sum()), "bits": bits, "lengths": lengths.tobytes(),
        "t1": np.array([h[0] for h in held], dtype=np.int64).tobytes(), "t2": np.array([h[1] for h in held], dtype=np.int64).tobytes(),
        "slices": np.packbits(matrix, axis=1).tobytes(),
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[f[0] for f in fields])


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, and counts of documents per term, of one task."""
    found: Counter = Counter()
    held: dict[int, list[tuple]] = {}

    def counted() -> pa.RecordBatch:
        columns = {"term": pa.array(found.keys(), pa.binary()), "df": pa.array(found.values(), pa.int64())}
        kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
        fields = [f.split() for f in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(len(found), kinds[k])) for n, k in fields], names=[f[0] for f in fields])

    for batch in batches:
        for t1, t2, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            counts = terms(data.as_py())
            if not counts:
                continue
            found.update(counts.keys())
            hashes, levels = _signature_keys(counts)
            bits = BITS_PER_KEY << max(6, (len(hashes) - 1).bit_length())
            docs = held.setdefault(bits, [])
            docs.append((t1, t2, sum(counts.values()), hashes, levels))
            if len(docs) >= max(8, min(BLOCK_DOCS, BLOCK_BITS // bits)):
                yield _batch([_block(held.pop(bits), bits)])
            if len(found) >= COUNTED:
                yield counted()
                found.clear()
    for bits in list(held):
        yield _batch([_block(held.pop(bits), bits)])
    if found:
        yield counted()


def _text_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``t1, t2`` (hashes of the text), ``none, id`` (the place in the order of ids) and the text of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
        text.cast("binary").alias("data"),
    )


class LexicalIndex:
    """Blocks of signatures and the dictionary of a document table, in two folders under ``path``."""

    def __init__(self, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        bounded_batches(self.spark)
        self.docs = _text_keys(docs, id_col, text_col)
        raw = f"{path}/raw"
        self.docs.select("t1", "t2", "data").mapInArrow(_index_rows, INDEX).write.option("compression", "zstd").parquet(raw)
        rows = self.spark.read.schema(INDEX).parquet(raw)
        self.blocks = rows.where("term is null").select("bits", "t1", "t2", "lengths", "slices")
        self.frequencies = rows.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
        totals = rows.where("term is null").agg(F.sum("docs"), F.sum("words")).first()
        self.n_docs, self.n_words = totals[0] or 0, totals[1] or 0
        self.places = stored(self.docs.select("t1", "t2", "none", "id"))

    def search(self, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """``item, rank, id, score``: the ``k`` best documents of every row of ``queries``."""
        asked = stored(queries.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")))
        weighed = self._weighed(asked)
        size = weighed.agg(F.count(F.lit(1)), F.count_distinct("uid")).first()
        passes = max(1, math.ceil(size[0] / PASS_TERMS), math.ceil(size[1] / PASS_QUERIES))
        found = None
        for number in range(passes if self.n_docs else 0):
            mine = weighed.where(F.pmod(F.xxhash64("uid"), F.lit(passes)) == number)
            scored = self._pass(mine.collect(), k)
            found = scored if found is None else found.unionByName(scored)
        if found is None:
            found = self.spark.createDataFrame([], "uid long, t1 long, t2 long, score long")
        wanted = self.places.join(found.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")
        few = wanted.withColumn("copy", F.row_number().over(Window.partitionBy("t1", "t2").orderBy("none", "id"))).where(F.col("copy") <= k)
        ordered = Window.partitionBy("uid").orderBy(F.col("score").desc(), "none", "id")
        best = found.join(few.drop("copy"), ["t1", "t2"]).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
        return best.join(asked.select("uid", "item"), "uid").select("item", "rank", "id", "score")

    def _weighed(self, asked: DataFrame) -> DataFrame:
        """``uid, term, weight`` of the terms that occur in the corpus."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = list(terms(data.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["uid", "term"])

        each = stored(asked.select("uid", "data").mapInArrow(run, "uid long, term binary"))
        known = self.frequencies.join(each.select("term").distinct(), "term", "left_semi")
        n = self.n_docs
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
        return cut(each.join(known, "term").select("uid", "term", weight.alias("weight")))

    def _pass(self, weighed: list, k: int) -> DataFrame:
        """``uid, t1, t2, score`` of all documents that can be among the ``k`` best of the queries of one pass."""
        asked = _Queries(weighed, self.n_docs, self.n_words)
        several = k * FLOOR_TIMES
        bounds = self.blocks.mapInArrow(lambda batches: asked.largest(batches, several), "uid long, bound long, t1 long, t2 long")
        largest = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("bound").desc(), "t1", "t2"))
        first = cut(bounds.withColumn("at", largest).where(F.col("at") <= several).select("uid", "t1", "t2"))
        scored = first.join(self._scored(first, asked, small=True), ["uid", "t1", "t2"])
        best = scored.withColumn("at", F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc())))
        floor = {r.uid: r.score for r in best.where(F.col("at") == k).collect()}
        reached = self.blocks.mapInArrow(lambda batches: asked.reached(batches, floor), "uid long, t1 long, t2 long")
        return cut(self._scored(cut(reached.distinct()), asked, small=False).where("score > 0"))

    def _scored(self, pairs: DataFrame, asked: _Queries, small: bool) -> DataFrame:
        """``uid, t1, t2, score`` of pairs ``uid, t1, t2``: each text is read from one of its rows, once for all its queries."""
        texts = pairs.groupBy("t1", "t2").agg(F.collect_set("uid").alias("uids"))
        place = F.min(F.struct("none", "id")).alias("place")
        chosen = self.places.join(F.broadcast(texts) if small else texts, ["t1", "t2"]).groupBy("t1", "t2").agg(place, F.any_value("uids").alias("uids"))
        chosen = cut(chosen.select("t1", "t2", F.col("place.none").alias("none"), F.col("place.id").alias("key"), "uids"))
        on = [self.docs[c] == chosen[c] for c in ("t1", "t2", "none")] + [self.docs["id"].eqNullSafe(chosen["key"])]
        read = self.docs.join(F.broadcast(chosen) if small else chosen, on).select(chosen["t1"], chosen["t2"], "uids", "data")
        return read.mapInArrow(asked.scored, "uid long, t1 long, t2 long, score long").groupBy("uid", "t1", "t2").agg(F.max("score").alias("score"))


class _Queries:
    """The weighed terms of the queries of one pass."""

    def __init__(self, weighed: list, n_docs: int, n_words: int):
        self.n_docs, self.n_words = n_docs, n_words
        rows = sorted((r.uid, bytes(r.term), r.weight) for r in weighed)
        self.vocabulary = sorted({term for _, term, _ in rows})
        number = {term: i for i, term in enumerate(self.vocabulary)}
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))
        self.uids = np.unique(np.array([r[0] for r in rows], dtype=np.int64))
        self.starts = np.searchsorted(np.array([r[0] for r in rows], dtype=np.int64), self.uids)
        self.term = np.array([number[term] for _, term, _ in rows], dtype=np.int64)
        self.weight = np.array([weight for _, _, weight in rows], dtype=np.int64)
        self.by_uid: dict[int, list[tuple[bytes, int]]] = {}
        for key, term, weight in rows:
            self.by_uid.setdefault(key, []).append((term, weight))

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        return 50 + (50 * lengths * self.n_docs) // self.n_words

    def bounds(self, bits: int, lengths: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bound of every query's score (rows) in every document of a block (columns)."""
        docs = len(lengths)
        matrix = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        norm = self.norms(lengths)
        out = np.zeros((len(self.uids), docs), dtype=np.int64)
        alive = np.arange(len(self.vocabulary))
        present = np.full((len(alive), matrix.shape[1]), 255, dtype=np.uint8)
        level, below = 0, np.zeros(docs, dtype=np.int64)
        while len(alive):
            rows = positions(self.hashes[alive], level, bits)
            for j in range(HASHES):
                present &= matrix[rows[:, j]]
            some = present.any(axis=1)
            alive, present = alive[some], present[some]
            if not len(alive):
                break
            most = (2 << level) - 1
            impact = (10**9 * most) // (1000 * most + 20 * norm)
            self._add(out, alive, present, impact - below)
            below, level = impact, level + 1
        return out

    def _add(self, out: np.ndarray, alive: np.ndarray, present: np.ndarray, gain: np.ndarray) -> None:
        """Add each query's weights of the terms present, times ``gain`` per document, a bounded number of rows at a time."""
        docs = out.shape[1]
        index = np.full(len(self.vocabulary), -1, dtype=np.int64)
        index[alive] = np.arange(len(alive))
        place = index[self.term]
        held = np.flatnonzero(place >= 0)
        query = np.searchsorted(self.starts, held, side="right") - 1
        for at in range(0, len(held), 4096):
            rows, mine = held[at : at + 4096], query[at : at + 4096]
            bits = np.unpackbits(present[place[rows]], axis=1, count=docs)
            begins = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            sums = np.add.reduceat(bits * self.weight[rows][:, None], begins, axis=0)
            out[mine[begins]] += sums * gain

    def _blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int64)
                yield self.bounds(row["bits"], lengths, row["slices"]), np.frombuffer(row["t1"], np.int64), np.frombuffer(row["t2"], np.int64)

    def largest(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """The ``k`` largest bounds of each query within a task."""
        held: list[np.ndarray] | None = None
        for bound, t1, t2 in self._blocks(batches):
            new = [bound, np.broadcast_to(t1, bound.shape), np.broadcast_to(t2, bound.shape)]
            both = new if held is None else [np.concatenate(p, axis=1) for p in zip(held, new)]
            if both[0].shape[1] > k:
                best = np.argpartition(-both[0], k - 1, axis=1)[:, :k]
                both = [np.take_along_axis(x, best, axis=1) for x in both]
            held = both
        if held is not None:
            some = held[0] > 0
            keys = np.broadcast_to(self.uids[:, None], some.shape)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (keys, *held)], names=["uid", "bound", "t1", "t2"])

    def reached(self, batches: Iterator[pa.RecordBatch], floor: dict[int, int]) -> Iterator[pa.RecordBatch]:
        """The documents whose bound reaches the floor of a query."""
        least = np.array([max(1, floor.get(u, 1)) for u in self.uids.tolist()], dtype=np.int64)
        for bound, t1, t2 in self._blocks(batches):
            query, doc = np.nonzero(bound >= least[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(self.uids[query]), pa.array(t1[doc]), pa.array(t2[doc])], names=["uid", "t1", "t2"])

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact scores of ``t1, t2, uids, data``."""
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for t1, t2, uids, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                counts = terms(data.as_py())
                norm = 50 + (50 * sum(counts.values()) * self.n_docs) // self.n_words
                impact = {tf: (10**9 * tf) // (1000 * tf + 20 * norm) for tf in set(counts.values())}
                for key in uids:
                    out.append((key, t1, t2, sum(w * impact[counts[t]] for t, w in self.by_uid[key] if t in counts)))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "t1", "t2", "score"])


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, from an index of its own."""
    index = LexicalIndex(docs, f"{checkpoint_dir(docs.sparkSession)}/signatures-{uuid.uuid4().hex}")
    best = index.search(items, k)
    return best.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
