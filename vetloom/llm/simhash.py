"""SimHash near-duplicates through a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint of its word shingles; equal fingerprints are one class. Two fingerprints link at
``max_bits`` differing bits or fewer. Of ``max_bits + 1`` blocks of bits at least one is equal then, so each distinct
fingerprint is dealt to one bucket per block, and a bucket that grows beyond ``bucket_rows`` is dealt again by blocks of
its other bits, until no bucket is too large; no link is lost. In a bucket the fingerprints stand in Gray order, where
neighbours share most bits. Nodes over eight neighbours hold the bits that all below them share, each bit once, in the
highest node that has it. A search carries the differences found so far down the tree and drops a node, with all below
it, as soon as they exceed the bound. Groups that already hang together are not searched from within, so a dense group
yields one edge per member. Edges meet in the connected components.

A null or empty text has fingerprint zero and links like any other. Repeated rows are equal fingerprints. A null id is
larger than every id; a component of null ids only has a null component id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetloom.llm.graph import components
from vetloom.llm.shared import LOWER, bounded_batches, cut, id_and_bytes

SEED = 42
FANOUT = 8
#: Pairs of a query and a node that a search holds at once.
FRONTIER = 2_000_000
#: Rows that a task gathers before it searches; whole buckets always.
SEARCH_ROWS = 50_000


def fingerprint(data: bytes, width: int = 3, block: int = 1 << 16) -> int:
    """Majority of the bits of XXH64 over the word shingles, repeats included; zero without words."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    text = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, block):
        raw = b"".join([digest(text[s:e], SEED) for s, e in zip(first[at : at + block], last[at : at + block])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row."""
    bounded_batches(docs.sparkSession)
    rows = id_and_bytes(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(d.as_py(), width) for d in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(column):
    """Place of a 64-bit word in Gray-code order (as a signed long; order within a bucket is all that counts)."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column


def block_masks(fixed: int, parts: int) -> list[int]:
    """``fixed`` plus one block each of the bits outside it, cut into ``parts`` blocks."""
    free = [1 << b for b in range(64) if not fixed >> b & 1]
    parts = min(parts, len(free))
    return [fixed | sum(free[len(free) * i // parts : len(free) * (i + 1) // parts]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class GrayIndex:
    """Hierarchical index over fingerprints that stand by bucket and, within it, in Gray order."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        self.fps = fps
        n = len(fps)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        both, any_, first = fps, fps, np.arange(n)
        last = np.arange(n)
        zero = np.zeros(n, dtype=np.uint64)
        levels = [{"mask": ~zero, "bits": fps, "first": first, "last": last}]
        owner = starts  # first entry of each bucket at the present level
        while len(first) > len(starts):
            within = np.arange(len(first)) - np.repeat(owner, np.diff(np.append(owner, len(first))))
            cuts = np.flatnonzero(within % FANOUT == 0)
            both, any_ = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(any_, cuts)
            ends = np.append(cuts[1:], len(first))
            owner = np.searchsorted(cuts, owner)
            first, last = first[cuts], last[ends - 1]
            levels[-1]["parent"] = np.repeat(np.arange(len(cuts)), ends - cuts)
            levels.append({"mask": ~(both ^ any_), "bits": both, "first": first, "last": last, "from": cuts, "to": ends})
        self.levels = levels[::-1]
        for upper, lower in zip(self.levels, self.levels[1:]):
            lower["rest"] = lower["mask"] & ~upper["mask"][lower["parent"]]  # bits that no upper node has yet
        self.root = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))

    def search(self, queries: np.ndarray, bound: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (query, later entry) within the bound that aren't yet of one label; None if too much is open at once."""
        q, node = queries, self.root[queries]
        far = np.zeros(len(q), dtype=np.int64)
        for depth, level in enumerate(self.levels):
            if depth:
                upper = self.levels[depth - 1]
                size = upper["to"][node] - upper["from"][node]
                total = int(size.sum())
                if total > FRONTIER and len(queries) > 1:
                    return None
                q, far = np.repeat(q, size), np.repeat(far, size)
                node = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(upper["from"][node], size)
                far = far + np.bitwise_count((self.fps[q] ^ level["bits"][node]) & level["rest"][node])
            lows, highs = np.minimum.reduceat(label, level["first"]), np.maximum.reduceat(label, level["first"])
            joined = (lows[node] == highs[node]) & (lows[node] == label[q])
            keep = (far <= bound) & (level["last"][node] > q) & ~joined
            q, node, far = q[keep], node[keep], far[keep]
        return q, node

    def links(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges (entry, first entry of its group) that connect what links within the buckets."""
        n = len(self.fps)
        label = np.arange(n)
        open_ = [(a, min(a + 8192, n)) for a in range(0, n, 8192)][::-1]
        while open_:
            a, b = open_.pop()
            pairs = self.search(np.arange(a, b), bound, label)
            if pairs is None:
                middle = (a + b) // 2
                open_ += [(middle, b), (a, middle)]
            elif len(pairs[0]):
                label = merged(label, *pairs)
        moved = np.flatnonzero(label != np.arange(n))
        return moved, label[moved]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the groups of each pair are joined; a label is the smallest entry of its group."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def bucket_links(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """Edges from rows ``mask, value, fp`` that stand by bucket; holds whole buckets, each of bounded size."""

    def out(mask, value, fps):
        new = np.concatenate(([False], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
        a, b = GrayIndex(fps, np.cumsum(new)).links(bound)
        edges = [pa.array(fps[x].view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(edges, names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        if sum(len(h[0]) for h in held) < SEARCH_ROWS:
            continue
        mask, value, fps = (np.concatenate(c) for c in zip(*held))
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
        if len(new):  # the last bucket may go on in the next batch
            at = new[-1] + 1
            yield out(mask[:at], value[:at], fps[:at].view(np.uint64))
            held = [(mask[at:], value[at:], fps[at:])]
        else:
            held = [(mask, value, fps)]
    if held:
        mask, value, fps = (np.concatenate(c) for c in zip(*held))
        yield out(mask, value, fps.view(np.uint64))


def links(fps: DataFrame, max_bits: int = 3, bucket_rows: int = 1 << 17) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``fp`` that connect exactly what links within ``max_bits``."""
    masks = block_masks(0, max_bits + 1)
    dealt = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    dealt = dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    ready: DataFrame | None = None
    while True:
        large = cut(dealt.groupBy("mask", "value").count().where(F.col("count") > bucket_rows).select("mask", "value"))
        if large.isEmpty():
            ready = dealt if ready is None else ready.union(dealt)
            break
        small = dealt.join(large, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        ready = small if ready is None else ready.union(small)
        finer = [(m, x) for m in masks for x in block_masks(m, max_bits + 1)]
        table = F.create_map(*[c for m in masks for c in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for k, x in finer if k == m]))])
        dealt = dealt.join(large, ["mask", "value"], "left_semi").select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        dealt = cut(dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct())
        masks = sorted({x for _, x in finer})
    placed = ready.repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("fp")))
    return placed.select("mask", "value", "fp").mapInArrow(lambda batches: bucket_links(batches, max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    rows = cut(fingerprints(docs, id_col, text_col, width))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(classes.select("fp"), max_bits))
    rooted = classes.join(joined, classes["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def placed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, text, place, k1, k2``: each row as it is, its text, its place in the order and two hashes of both."""
    whole = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).isNull(), F.col(id_col)).alias("place"), F.col(text_col).alias("text"))
    return whole.select("row", "text", "place", F.xxhash64("place", "text").alias("k1"), F.xxhash64("text", F.lit(7), "place").alias("k2"))


def one_of_each(keyed: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of the smallest ``least`` of each ``root``; of equal rows one."""
    first = rooted.groupBy("root").agg(F.min("least").alias("key")).select("key.k1", "key.k2")
    chosen = keyed.select("row", "k1", "k2").join(first, ["k1", "k2"])
    equal = Window.partitionBy("k1", "k2").orderBy("k1")
    return chosen.withColumn("n", F.row_number().over(equal)).where("n = 1").select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, every column as it is, with one row left of each component: that of the smallest id.

    Among rows of the smallest id the one with the smallest row hash stays, and of equal rows one.
    """
    keyed = placed_rows(docs, id_col, text_col)
    rows = cut(fingerprints(keyed.select(F.struct("place", "k1", "k2").alias("key"), "text"), "key", "text", width))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(classes.select("fp"), max_bits))
    rooted = classes.join(joined, classes["fp"] == joined["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    return one_of_each(keyed, rooted)
