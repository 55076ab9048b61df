"""Benchmark decontamination with suffix arrays of the training text.

The documents of a step form a shard: their words are numbered by the benchmark's vocabulary (other words break the text),
and the suffixes that can hold a window are sorted. Every distinct window that starts at some place of an item (13 words,
or the whole of a shorter item) is binary-searched in the shard's suffix array; the range found gives all its places.
From each place the match is followed to its full length. The benchmark reaches the tasks in blocks of a bounded number
of words, one broadcast per block, and each shard is searched for all of them; documents are read once.

A null or empty document has no words, no hits and is clean. A null or empty item has no windows. Equal items under two
ids both count; repeated rows of one id count once; the id of an item without one is written ``null``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vetloom.llm.shared import bounded_batches, id_and_bytes, steps

WINDOW = 13
#: Benchmark words in one broadcast block.
BLOCK_WORDS = 500_000
#: Blocks that a worker keeps in memory; with more, each is read again from the executor's copy for every shard.
KEPT_BLOCKS = 4
#: Lower-case letters, digits and all bytes outside ASCII stay; other bytes become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class Block:
    """Some items of the benchmark: their words as numbers, and each distinct window with the items that hold it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        numbers = [[number(w, len(self.vocabulary)) for w in words] for _, words in items]
        self.shortest = min([window, *map(len, numbers)])
        self.words = np.array([x for n in numbers for x in (*n, -1)] + [-1], dtype=np.int64)
        self.starts: list[int] = []
        found: dict[tuple, list[tuple[int, int]]] = {}
        at = 0
        for item, n in enumerate(numbers):
            width = min(window, len(n))
            self.starts.append(at)
            for i in range(len(n) - width + 1):
                found.setdefault(tuple(n[i : i + width]), []).append((item, at + i))
            at += len(n) + 1
        self.windows = np.full((len(found), window), -2, dtype=np.int64)
        for i, w in enumerate(found):
            self.windows[i, : len(w)] = w
        self.widths = np.array([len(w) for w in found], dtype=np.int64)
        self.places = list(found.values())


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``words``, sorted by their first ``depth`` numbers or more, by prefix doubling."""
    rank = words - words.min() if len(words) else words
    done = 1
    while done < depth:
        later = np.zeros(len(rank), dtype=np.int64)
        later[: len(rank) - done] = rank[done:] + 1
        _, rank = np.unique(rank * (int(later.max(initial=0)) + 1) + later, return_inverse=True)
        done *= 2
    return np.argsort(rank, kind="stable")


def bounds(words: np.ndarray, order: np.ndarray, windows: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-the-last place in ``order`` of the suffixes that start with each window."""
    padded = np.append(words, np.full(windows.shape[1], -1, dtype=np.int64))

    def search(after: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(order), dtype=np.int64)
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) // 2
            sign = np.zeros(len(live), dtype=np.int64)
            start = order[middle]
            for place in range(windows.shape[1]):
                undecided = (sign == 0) & (place < widths[live])
                if not undecided.any():
                    break
                sign = np.where(undecided, np.sign(padded[start + place] - windows[live, place]), sign)
            right = (sign < 0) | (after & (sign == 0))
            low[live] = np.where(right, middle + 1, low[live])
            high[live] = np.where(right, high[live], middle)
        return low

    return search(False), search(True)


def shard_matches(numbers: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``numbers`` (-1 breaks it) where windows occur, the number of the window, and the length of the match.

    The length is that of the longest verbatim match from there on, over all items that hold the window.
    """
    known = np.concatenate(([False], numbers >= 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= block.shortest]
    if not len(edges) or not len(block.widths):
        return (np.zeros(0, dtype=np.int64),) * 3
    # the runs that are long enough, with one break after each
    size = edges[:, 1] - edges[:, 0] + 1
    shift = np.repeat(edges[:, 0] - (np.cumsum(size) - size), size)
    place = np.arange(len(shift)) + shift
    text = np.append(numbers, -1)[place]
    text[np.cumsum(size) - 1] = -1
    left = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(text))  # words to the end of the run
    order = suffix_array(text, block.windows.shape[1])
    order = order[left[order] >= block.shortest]
    low, high = bounds(text, order, block.windows, block.widths)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    at = order[np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    length = block.widths[window].copy()
    # follow each match; a window that several places of the benchmark hold is followed from each of them
    held = np.array([len(p) for p in block.places], dtype=np.int64)
    starts = np.array([s for p in block.places for _, s in p], dtype=np.int64)
    first = np.cumsum(held) - held
    for turn in range(int(held.max())):
        rows = np.flatnonzero(held[window] > turn)
        source = starts[first[window[rows]] + turn]
        reach = block.widths[window[rows]].copy()
        live = np.arange(len(rows))
        while len(live):
            a, b = text[at[rows[live]] + reach[live]], block.words[source[live] + reach[live]]
            live = live[(a == b) & (a >= 0)]
            reach[live] += 1
        length[rows] = np.maximum(length[rows], reach)
    return place[at], window, length


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[Block]:
    """The benchmark in blocks; only one block is held at a time."""
    items: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col)).where(F.col(text_col).isNotNull())
    for name, text in rows.toLocalIterator():
        words = words_of(text.encode())
        if not words:
            continue
        if items and size + len(words) > block_words:
            yield Block(items, window)
            items, size = [], 0
        items.append((name, words))
        size += len(words)
    if items:
        yield Block(items, window)


def find_matches(texts: list[bytes], block: Block) -> list[tuple[int, str, int, int, int]]:
    """``text, item, text word, item word, length`` of the verbatim matches that no longer one holds, words from 0 on."""
    split = [words_of(t) for t in texts]
    size = np.array([len(w) + 1 for w in split], dtype=np.int64)
    start = np.cumsum(size) - size
    numbers = np.fromiter((x for w in split for x in (*[block.vocabulary.get(v, -1) for v in w], -1)), np.int64, int(size.sum()))
    at, window, _ = shard_matches(numbers, block)
    out = []
    for a, w in zip(at.tolist(), window.tolist()):
        text = int(np.searchsorted(start, a, side="right")) - 1
        for item, b in block.places[w]:
            first = b - block.starts[item]
            if a > start[text] and first > 0 and numbers[a - 1] == block.words[b - 1]:
                continue  # begins earlier
            n = int(block.widths[w])
            while numbers[a + n] >= 0 and numbers[a + n] == block.words[b + n]:
                n += 1
            out.append((text, block.names[item], int(a - start[text]), int(first), n))
    return sorted(out)


def _report(texts: list[bytes], shipped: list) -> list[tuple[int, int, list[str], int]]:
    """Words, hit words, names of the items met and the longest match, per text."""
    split = [words_of(t) for t in texts]
    size = np.array([len(w) + 1 for w in split], dtype=np.int64)
    start = np.cumsum(size) - size
    hits = np.zeros(int(size.sum()) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    longest = np.zeros(len(texts), dtype=np.int64)
    for share in shipped:
        block: Block = share.value
        if len(shipped) > KEPT_BLOCKS:
            share.__dict__.pop("_value", None)
        get = block.vocabulary.get
        numbers = np.fromiter((x for w in split for x in (*[get(v, -1) for v in w], -1)), np.int64, int(size.sum()))
        at, window, length = shard_matches(numbers, block)
        np.add.at(hits, at, 1)
        np.add.at(hits, at + block.widths[window], -1)
        owner = np.searchsorted(start, at, side="right") - 1
        np.maximum.at(longest, owner, length)
        for doc, w in np.unique(np.stack([owner, window], axis=1), axis=0).tolist():
            items[doc].update(block.names[i] for i, _ in block.places[w])
    covered = np.cumsum(hits) > 0
    return [
        (len(w), int(np.count_nonzero(covered[s : s + len(w)])), sorted(i), int(m)) for w, s, i, m in zip(split, start, items, longest)
    ]


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per longest verbatim match: ``doc_id, item_id`` (as text), the first words of the match, and its length."""
    bounded_batches(docs.sparkSession)
    shipped = _shipped(docs, benchmark, item_col, item_text)
    rows = id_and_bytes(docs, id_col, text_col)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            for share in shipped:
                found = find_matches(texts, share.value)
                if len(shipped) > KEPT_BLOCKS:
                    share.__dict__.pop("_value", None)
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in columns[0]], to_arrow_type(kind)), pa.array(columns[1], pa.string()),
                        *(pa.array(c, pa.int64()) for c in columns[2:]),
                    ],
                    names=["doc_id", "item_id", "doc_word", "item_word", "length"],
                )

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, item_id string, doc_word long, item_word long, length long")


def _shipped(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> list:
    context = docs.sparkSession.sparkContext
    return [context.broadcast(b) for b in blocks(benchmark, item_col, item_text)]


def report(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document: words, hit words, items met, the longest verbatim match in words, and the verdict."""
    bounded_batches(docs.sparkSession)
    shipped = _shipped(docs, benchmark, item_col, item_text)
    rows = id_and_bytes(docs, id_col, text_col)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            found = _report(texts, shipped)
            digest = [hashlib.sha256(",".join(i).encode()).hexdigest() for _, _, i, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, to_arrow_type(kind)), pa.array([w for w, *_ in found], pa.int64()),
                    pa.array([h for _, h, *_ in found], pa.int64()), pa.array([len(i) for _, _, i, _ in found], pa.int64()),
                    pa.array(digest, pa.string()), pa.array([h > 0 and 20 * h >= w for w, h, *_ in found], pa.bool_()),
                    pa.array([m for *_, m in found], pa.int64()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"
    )


def is_contaminated(docs: DataFrame, benchmark: DataFrame, text: Column, item_col: str = "item_id", item_text: str = "text") -> Column:
    """A column that is true where ``text`` is contaminated by the benchmark."""
    shipped = _shipped(docs, benchmark, item_col, item_text)

    @F.pandas_udf("boolean")
    def judge(data):
        out = []
        for _, texts in steps([pa.RecordBatch.from_arrays([pa.nulls(len(data)), pa.array(map(bytes, data), pa.binary())], names=["id", "data"])]):
            out += [h > 0 and 20 * h >= w for w, h, *_ in _report(texts, shipped)]
        return data.map(lambda _: False) if not out else type(data)(out, index=data.index)

    return judge(F.coalesce(text, F.lit("")).cast("binary"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, every column as it is, that the benchmark doesn't contaminate."""
    bounded_batches(docs.sparkSession)
    return docs.where(~is_contaminated(docs, benchmark, F.col(text_col), item_col, item_text))
