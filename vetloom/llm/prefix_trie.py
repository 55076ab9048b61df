"""Prefix trie of conversations from sorted sequences, their longest common prefixes and range minima.

1. Every turn becomes 16 bytes (MD5 of role and text) and a word count; a conversation is one row: its turns' bytes in order.
2. Equal conversations become one row with their number and smallest id (partial aggregates first).
3. The rows are sorted by their bytes over range partitions. Neighbours of the order share the longest prefixes, ``lcp``.
4. In a partition a sparse table answers "least lcp between two places" at once. Every prefix that a row has and its
   predecessor hasn't is a candidate; it binary-searches its left and its right extent, each on its own, by range minima.
   The interval holds its members, and running totals give what the subtree sums up to; no stack, no walk down the trie.
5. An interval that touches a partition's border and goes on beyond it is a part of a node. Parts, one per node of a
   border and partition, are added up by the prefix they stand for; children of such nodes take its id from there.

The driver sees one number per partition: how long a prefix the partition shares with the next one. It comes from the
first and last sequence of each partition (16 bytes a turn). A task holds one partition of sequences, 32 bytes a turn.

Turns of one number are ordered by role and text hash; a null turn number comes first; null roles and texts are empty. A
null conversation id is one conversation, without turns of another; it is never the smallest id unless it is the only
member, and has no digits among the ends. Repeated rows are repeated turns. An empty table has no conversations, and no
root. Other columns of the table aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.llm.shared import bounded_batches, cut, stored

TURN = 16
#: Ids of one piece of a member list.
PIECE = 4096
#: Rows of the table of border nodes that are broadcast; a larger one is joined by the keys with salt.
BROADCAST_ROWS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends string"
)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turns``: per conversation the array of ``turn, none, code, words`` in order."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    code = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    each = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), code.alias("code"), words.alias("words")).alias("one"))
    return each.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def grafted(by_conv: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """``conv, turns`` with the first ``crc32(conv) % most`` turns taken from conversation ``conv - conv % group``."""
    taken = F.coalesce(F.crc32(F.col("conv").cast("string").cast("binary")) % most, F.lit(0)).cast("int")
    base = by_conv.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = by_conv.select("conv", "turns", (F.col("conv") - F.col("conv") % group).alias("base"), taken.alias("taken"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("taken"))
    rest = F.slice(F.col("turns"), F.col("taken") + 1, F.size("turns"))
    return own.join(base, "base", "left").select("conv", F.concat(head, rest).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """``seq, ends``: SHA-256 of the sorted ids of each sequence, from pieces of at most ``PIECE`` ids in order."""
    pieces = members.where("conv is not null").groupBy("seq", F.floor(F.col("conv") / PIECE).alias("piece"))
    pieces = pieces.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for seq, ids in zip(batch.column(0), batch.column(1)):
                seq, ids = seq.as_py(), ids.as_py().encode()
                if seq != now:
                    if now is not None:
                        done.append((now, total.hexdigest()))
                    now, total = seq, hashlib.sha256(ids)
                else:
                    total.update(b"," + ids)
            yield pa.RecordBatch.from_pydict({"seq": pa.array([d[0] for d in done], pa.binary()), "ends": pa.array([d[1] for d in done], pa.string())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([now], pa.binary()), "ends": pa.array([total.hexdigest()])})

    ordered = pieces.repartition("seq").sortWithinPartitions("seq", "piece").select("seq", "ids")
    return ordered.mapInArrow(run, "seq binary, ends string")


def _sequences(by_conv: DataFrame) -> DataFrame:
    """``seq, words, n, least, ends`` of each different conversation, sorted over range partitions that later steps keep."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["code"])), ""))
    rows = stored(by_conv.select("conv", seq.alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words")))
    classes = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.first("words").alias("words"))
    single = classes.where("n = 1").withColumn("ends", F.sha2(F.coalesce(F.col("least").cast("string"), F.lit("")).cast("binary"), 256))
    several = classes.where("n > 1")
    listed = _ends(rows.select("seq", "conv").join(several.select("seq"), "seq", "left_semi"))
    several = several.join(listed, "seq", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
    every = cut(single.unionByName(several).select("seq", "words", "n", "least", "ends"))
    return cut(every.repartitionByRange("seq").sortWithinPartitions("seq"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two sequences begin with in common."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // TURN
    x, y = np.frombuffer(a, np.uint8, size), np.frombuffer(b, np.uint8, size)
    return int(np.argmax(x != y)) // TURN


class RangeMinimum:
    """Sparse table over an array: the least value of any stretch from two overlapping powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def first_left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Smallest ``l <= at`` with all of ``values[l + 1 .. at] >= bound``: powers of two from the largest, each taken if it holds."""
        place = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            size = 1 << k
            start = place - size + 1
            fits = start >= 1
            fits &= self.levels[k][np.where(fits, start, 0)] >= bound
            place = np.where(fits, place - size, place)
        return place

    def last_right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Largest ``r >= at`` with all of ``values[at + 1 .. r] >= bound``."""
        n, place = len(self.levels[0]), at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            size = 1 << k
            fits = place + size < n
            fits &= self.levels[k][np.where(fits, place + 1, 0)] >= bound
            place = np.where(fits, place + size, place)
        return place


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


def interval_nodes(seqs: list[bytes], words: list[np.ndarray], n: np.ndarray, least: list, ends: list[str], before: int, after: int) -> pa.RecordBatch:
    """The nodes, or parts of nodes, of one partition; ``before`` and ``after`` are the turns shared across its borders (-1: none)."""
    rows = len(seqs)
    size = np.array([len(s) // TURN for s in seqs], dtype=np.int64)
    lcp = np.array([before] + [shared_turns(a, b) for a, b in zip(seqs, seqs[1:])], dtype=np.int64)
    follow = np.append(lcp[1:], after)
    leaf = (follow < size).astype(np.int64)
    ids = np.array([np.iinfo(np.int64).max if x is None else x for x in least], dtype=np.int64)

    # words up to each depth, depth 0 first, all rows end to end
    offset = _sums(size + 1)
    flat = np.zeros(offset[-1], dtype=np.int64)
    for i, w in enumerate(words):
        flat[offset[i] + 1 : offset[i + 1]] = np.cumsum(w)
    total = flat[offset[1:] - 1]
    fresh = total - flat[offset[:-1] + np.maximum(lcp, 0)]  # words of the nodes that begin with this row
    n_sum, leaf_sum, all_sum, fresh_sum = _sums(n), _sums(leaf), _sums(n * total), _sums(fresh)

    # candidates: depths that the row's predecessor in this partition doesn't have
    local = lcp.copy()
    local[0] = -1
    counts = size - local
    at = np.repeat(np.arange(rows), counts)
    depth = np.arange(len(at)) - np.repeat(_sums(counts)[:-1], counts) + np.repeat(local + 1, counts)
    inside = lcp.copy()
    inside[0] = -1
    table = RangeMinimum(inside)
    left, right = table.first_left(at, depth), table.last_right(at, depth)
    from_left = (left == 0) & (before >= depth)
    open_ = from_left | ((right == rows - 1) & (after >= depth))

    step = flat[offset[at] + depth - (depth > 0)]  # words before the node's last turn
    first_words = np.where(from_left, fresh[left], total[left] - step)
    distinct_words = first_words + fresh_sum[right + 1] - fresh_sum[left + 1]
    member_words = all_sum[right + 1] - all_sum[left] - (n_sum[right + 1] - n_sum[left]) * step

    # a node's parent holds the row where the node begins: its own row, or for the row's first new depth one to the left
    place = offset[:-1]  # node number of (row, depth) is its place in flat
    number = place[at] + depth
    index = np.full(offset[-1], -1, dtype=np.int64)
    index[number] = np.arange(len(at))
    up = np.maximum(depth - 1, 0)
    begins = table.first_left(at, up)
    parent = index[place[begins] + up]
    real = depth > np.where(at == 0, before, local[at])  # nodes that begin here, seen over all partitions
    children = np.bincount(parent[(depth > 0) & real], minlength=len(at))

    spans = right - left + 1
    level = np.floor(np.log2(spans)).astype(np.int64)
    lows = RangeMinimum(ids).levels
    smallest = np.empty(len(at), dtype=np.int64)
    for k in np.unique(level):
        rows_k = level == k
        smallest[rows_k] = np.minimum(lows[k][left[rows_k]], lows[k][right[rows_k] - (1 << k) + 1])
    known = smallest != np.iinfo(np.int64).max

    keys = [hashlib.md5(seqs[i][: TURN * d]).digest() if o else None for i, d, o in zip(left.tolist(), depth.tolist(), open_.tolist())]
    above = [keys[p] if d else None for p, d in zip(parent.tolist(), depth.tolist())]
    own_end = size[left] == depth
    ending = [ends[i] if e else None for i, e in zip(left.tolist(), own_end.tolist())]
    parent_ids = pa.array(smallest[parent], mask=~known[parent] | (depth == 0) | open_[parent])
    columns = [
        pa.array(keys, pa.binary()), pa.array(above, pa.binary()), pa.array(smallest, mask=~known), pa.array(depth), parent_ids,
        pa.array(n_sum[right + 1] - n_sum[left]), pa.array(children.astype(np.int64)), pa.array(leaf_sum[right + 1] - leaf_sum[left]),
        pa.array(member_words - distinct_words), pa.array(ending, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODE.split(", ")])


def _borders(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """Per partition that has rows: turns shared with the one before and the one after it, -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[bytes] = []
        part = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                ends = [ends[0] if ends else batch.column(1)[0].as_py(), batch.column(1)[batch.num_rows - 1].as_py()]
        if ends:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": pa.array([ends[0]], pa.binary()), "last": pa.array([ends[1]], pa.binary())})

    rows = ordered.select(F.spark_partition_id().alias("part"), "seq").mapInArrow(run, "part int, first binary, last binary").collect()
    rows.sort(key=lambda r: r.part)
    shared = [-1, *[shared_turns(bytes(a.last), bytes(b.first)) for a, b in zip(rows, rows[1:])], -1]
    return {r.part: (shared[i], shared[i + 1]) for i, r in enumerate(rows)}


def _salted(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salts: int = 32) -> DataFrame:
    """Left join on a key that very many rows of ``left`` may share; ``right`` has one row per key."""
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth", "n_leaves"), F.lit(salts)).cast("int"))
    return salted.join(spread, (F.col(left_key) == F.col(right_key)) & (salted["salt"] == spread["salt"]), "left").drop("salt")


def nodes(by_conv: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conv, turns``; columns as of the contract, with the ids of the parents."""
    bounded_batches(by_conv.sparkSession, rows=10_000)
    ordered = _sequences(by_conv)
    borders = _borders(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            whole = pa.Table.from_batches(parts).combine_chunks()
            seqs = whole.column("seq").to_pylist()
            words = [np.asarray(w, dtype=np.int64) for w in whole.column("words").to_pylist()]
            count = whole.column("n").to_numpy()
            before, after = borders[whole.column("part")[0].as_py()]
            yield interval_nodes(seqs, words, count, whole.column("least").to_pylist(), whole.column("ends").to_pylist(), before, after)

    found = cut(ordered.select(F.spark_partition_id().alias("part"), "seq", "words", "n", "least", "ends").mapInArrow(run, NODE))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    firsts = [F.max(c).alias(c) for c in ("depth", "parent_key", "parent_conv_id", "ends")]
    merged = cut(found.where("key is not null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *firsts, *sums))
    every = found.where("key is null").unionByName(merged)
    above = merged.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    if merged.count() <= BROADCAST_ROWS:
        placed = every.join(F.broadcast(above), every["parent_key"] == above["up"], "left")
    else:
        placed = _salted(every, above, "parent_key", "up")
    return placed.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations of a table ``conv_id, turn, role, text``, each with the head of its group grafted on."""
    return nodes(grafted(cut(turns(conversations))))
