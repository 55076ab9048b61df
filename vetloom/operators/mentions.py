"""Dictionary names in texts: a word automaton for dictionaries of bounded size, joins by first word beyond it.

A name matches where its words and what stands between them match in any letter case; the longest name wins at a place, a
corporate ending goes along, and hits that overlap are settled from left to right. Both ways give the same hits. Null texts
and texts without a name have none; null names and names that don't begin and end with a word never match; repeated names
count once, the one that is last in the order of name and descriptor.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vetloom.operators.review import cut
from vetloom.plans.spread import met_by_size

# Corporate endings taken along with a dictionary name, longest first (fixed values).
CORPORATE_ENDINGS = [
    " Holdings Limited", " Holdings Ltd", " Group Limited", " Group Ltd", " (Pty) Ltd", " Holdings", " Pty Ltd",
    " Limited", " Group", " Ltd", " Corp", " Inc",
]
WORD = r"[A-Za-z0-9_]+"
#: Names and descriptors of this many bytes in all are broadcast as an automaton (about 100 MB in a Python worker at the bound).
DICTIONARY_BYTES = 4 << 20
#: First words and names that make up more than one in ``COMMON`` of all words or pieces are joined by broadcast.
COMMON = 2_000
HITS = "array<struct<at:int,last:int,name:string,descriptor:string,mention:string>>"
_WORDS = re.compile(f"({WORD})")


class WordAutomaton:
    """Trie over the words of names and what stands between them, with failure links: all names in one pass over a text."""

    def __init__(self, names: Sequence[tuple[str, str]], endings: Sequence[str] = ()):
        self.endings = [(e.lower(), len(e), len(_WORDS.findall(e))) for e in endings]
        self.number: dict[str, int] = {}
        spelled: list[tuple[list[int], tuple[int, str, str, int]]] = []
        for name, descriptor in names:
            parts = _WORDS.split(name.lower())
            if len(parts) < 3 or parts[0] or parts[-1]:
                continue
            tokens = [self.number.setdefault(p, len(self.number)) for p in parts[1:-1]]
            spelled.append((tokens, (len(name.lower()), name, descriptor, len(tokens) // 2 + 1)))
        self.base = len(self.number) + 1
        self.step: dict[int, int] = {}
        self.ends: list[tuple[int, str, str, int] | None] = [None]
        below: list[list[tuple[int, int]]] = [[]]
        for tokens, end in spelled:
            state = 0
            for token in tokens:
                after = self.step.get(state * self.base + token)
                if after is None:
                    after = self.step[state * self.base + token] = len(self.ends)
                    below[state].append((token, after))
                    below.append([])
                    self.ends.append(None)
                state = after
            if self.ends[state] is None or end[1:3] > self.ends[state][1:3]:
                self.ends[state] = end
        self.opening = {word for word, token in self.number.items() if token in self.step}
        self.fail = [0] * len(self.ends)
        self.link = [0] * len(self.ends)  # the next shorter suffix that is a name
        queue = deque(after for _, after in below[0])
        while queue:
            state = queue.popleft()
            for token, after in below[state]:
                self.fail[after] = self._next(self.fail[state], token)
                queue.append(after)
            shorter = self.fail[state]
            self.link[state] = shorter if self.ends[shorter] else self.link[shorter]

    def _next(self, state: int, token: int) -> int:
        while True:
            after = self.step.get(state * self.base + token)
            if after is not None:
                return after
            if not state:
                return 0
            state = self.fail[state]

    def hits(self, text: str) -> list[dict]:
        parts = _WORDS.split(text)
        best: dict[int, tuple[int, str, str, int]] = {}
        opening, state, i, last = self.opening, 0, 1, len(parts) - 1
        while i < last:
            if not state:  # outside any name: on to the next word that begins one
                while i < last and parts[i].lower() not in opening:
                    i += 2
                if i >= last:
                    break
            token = self.number.get(parts[i].lower())
            state = 0 if token is None else self._next(state, token)
            i += 1
            if not i % 2:
                out = state if self.ends[state] else self.link[state]
                while out:
                    end = self.ends[out]
                    start = i // 2 - end[3]
                    if start not in best or best[start][0] < end[0]:
                        best[start] = end
                    out = self.link[out]
            if not state and not i % 2:
                i += 1  # no name begins with what stands between words
        found, free = [], 0
        for start in sorted(best):
            if start < free:
                continue
            _, name, descriptor, width = best[start]
            first, behind = 2 * start + 1, 2 * (start + width)
            ending, more = self._ending(parts, behind)
            free = start + width + more
            written = "".join(parts[first:behind]) + ending
            found.append({"at": start, "last": free, "name": name, "descriptor": descriptor, "mention": written})
        return found

    def _ending(self, parts: list[str], behind: int) -> tuple[str, int]:
        """The first listed ending that the text goes on with and that ends at a word's end, and its number of words."""
        for lower, size, words in self.endings:
            rest = "".join(parts[behind : behind + 2 * words + 1])
            if rest[:size].lower() == lower and not _WORDS.match(rest[size : size + 1]):
                return rest[:size], words
        return "", 0


_HELD: dict[str, WordAutomaton] = {}
#: Rows of a batch whose texts are Python strings at one time.
SLICE_ROWS = 256


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that a worker's memory doesn't follow the number of rows in a batch."""
    return (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))


def _found(docs: DataFrame, text: str, names: list[tuple[str, str]], endings: Sequence[str], column: str) -> DataFrame:
    """``docs`` with the hits of each text in ``column``; every Python worker builds the automaton once.

    A step of its own, not a column function: the planner can't copy it into the expressions that read the hits.
    """
    token, endings, kind = uuid.uuid4().hex, list(endings), to_arrow_type(T.DataType.fromDDL(HITS))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if token not in _HELD:
                _HELD.clear()
                _HELD[token] = WordAutomaton(names, endings)
            automaton = _HELD[token]
            for part in _small(batch):
                hits = [automaton.hits(t) if t is not None else [] for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, kind)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DataType.fromDDL(HITS))]))


def _bounded(names: DataFrame, limit: int) -> list[tuple[str, str]] | None:
    """The names if they are of ``limit`` bytes at most; one small job."""
    size = F.octet_length("name") + F.coalesce(F.octet_length("descriptor"), F.lit(0))
    total = names.where("name is not null").agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total > limit:
        return None
    return [(r["name"], r["descriptor"]) for r in names.where("name is not null").select("name", F.coalesce("descriptor", F.lit("")).alias("descriptor")).collect()]


def is_bounded(names: DataFrame, limit: int = DICTIONARY_BYTES) -> bool:
    """Whether a dictionary travels to the texts."""
    return _bounded(names, limit) is not None


def with_hits(docs: DataFrame, key: str, text: str, names: DataFrame, endings: Sequence[str] = CORPORATE_ENDINGS, limit: int = DICTIONARY_BYTES) -> DataFrame:
    """``docs`` with ``__hits``: whole-word mentions of dictionary names ``name, descriptor`` from left to right.

    A hit is ``(at, last, name, descriptor, mention)``: numbers of its first word and of the word behind it, and the text as
    written with its corporate ending. A dictionary of at most ``limit`` bytes travels to the texts, which aren't shuffled;
    of a larger one only the words of the texts that begin a name travel.
    """
    few = _bounded(names, limit)
    if few is not None:
        return _found(docs, text, few, endings, "__hits")
    found = _joined_hits(docs, names, key, text, endings).select(F.col(key).alias("__key"), F.col("hits").alias("__hits"))
    out = docs.join(found, docs[key].eqNullSafe(found["__key"]), "left").drop("__key")
    return out.withColumn("__hits", F.coalesce("__hits", F.array().cast(HITS)))


def mention_hits(
    docs: DataFrame, names: DataFrame, id_column: str, text: str, endings: Sequence[str] = CORPORATE_ENDINGS, limit: int = DICTIONARY_BYTES
) -> DataFrame:
    """``(id, hits)`` of the documents that mention a name; the hits as of ``with_hits``."""
    few = _bounded(names, limit)
    if few is None:
        return _joined_hits(docs, names, id_column, text, endings)
    return _found(docs.select(id_column, text), text, few, endings, "hits").where(F.size("hits") > 0).select(id_column, "hits")


def _ending(rest: Column, endings: Sequence[str]) -> Column:
    """The first listed ending that the text goes on with and that ends at a word's end, in the text's own case."""
    out = F.lit("")
    for e in reversed(endings):
        holds = F.lower(rest).startswith(e.lower()) & ~F.regexp_like(F.substring(rest, len(e) + 1, 1), F.lit(WORD))
        out = F.when(holds, F.substring(rest, 1, len(e))).otherwise(out)
    return out


def _joined_hits(docs: DataFrame, names: DataFrame, key: str, text: str, endings: Sequence[str]) -> DataFrame:
    """``(id, hits)`` by joins.

    Words that begin a name meet the widths of the names that begin with them; a text is cut only there, and only so wide.
    The pieces meet the names by equality. First words and names that very many texts share are joined by broadcast.
    """
    described = names.where("name is not null").select("name", F.coalesce("descriptor", F.lit("")).alias("descriptor"), F.lower("name").alias("gram"))
    dictionary = described.groupBy("gram").agg(F.max(F.struct("name", "descriptor")).alias("named"))
    first = F.lower(F.regexp_extract("gram", WORD, 0)).alias("first")
    sized = dictionary.select("gram", "named", first, F.size(F.regexp_extract_all("gram", F.lit(WORD), F.lit(0))).alias("width")).where("width > 0")
    widths = sized.groupBy("first").agg(F.sort_array(F.collect_set("width")).alias("widths"))

    words = docs.select(key, F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("at", "word"))
    words = words.where("word is not null").select(key, "at", F.lower("word").alias("first"))
    counts = words.groupBy("first").agg(F.count(F.lit(1)).alias("size")).join(widths, "first")
    total = counts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    starts = met_by_size(words, counts, "first", max(1, total // COMMON)).groupBy(key).agg(F.collect_list(F.struct("at", "widths")).alias("starts"))
    placed = starts.select(F.col(key).alias("__key"), "starts")
    split = docs.select(key, cut(F.col(text), WORD).alias("parts")).join(placed, docs[key].eqNullSafe(F.col("__key"))).drop("__key")

    more = 2 * max((len(re.findall(WORD, e)) for e in endings), default=0) + 1
    each = split.select(key, "parts", F.explode("starts").alias("s")).select(key, "parts", "s.at", F.explode("s.widths").alias("width"))
    written = F.array_join(F.slice("parts", 2 * F.col("at") + 2, 2 * F.col("width") - 1), "")
    rest = F.array_join(F.slice("parts", 2 * F.col("at") + 1 + 2 * F.col("width"), F.lit(more)), "")
    pieces = each.select(key, "at", "width", written.alias("written"), rest.alias("rest")).withColumn("gram", F.lower("written"))
    times = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).join(sized.select("gram", "named"), "gram")
    found = met_by_size(pieces, times, "gram", max(1, total // COMMON)).withColumn("ending", _ending(F.col("rest"), endings))
    last = F.col("at") + F.col("width") + F.size(F.regexp_extract_all("ending", F.lit(WORD), F.lit(0)))
    hit = F.struct("at", last.alias("last"), "named.name", "named.descriptor", F.concat("written", "ending").alias("mention"))
    best = found.groupBy(key, "at").agg(F.max_by(hit, F.length("gram")).alias("hit"))
    ordered = best.groupBy(key).agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast(HITS).alias("kept"))

    def take(state: Column, h: Column) -> Column:
        taken = F.struct(h["last"].alias("free"), F.concat(state["kept"], F.array(h)).alias("kept"))
        return F.when(h["at"] >= state["free"], taken).otherwise(state)

    return ordered.select(key, F.aggregate(F.col("hits").cast(HITS), start, take, lambda s: s["kept"]).alias("hits"))


def dictionary_mentions(
    docs: DataFrame, names: DataFrame, id_column: str, text: str, endings: Sequence[str] = CORPORATE_ENDINGS, limit: int = DICTIONARY_BYTES
) -> DataFrame:
    """``(id, name, mention, n, descriptor)`` per distinct whole-word mention; the mention in lower case."""
    rows = mention_hits(docs, names, id_column, text, endings, limit).select(id_column, F.explode_outer("hits").alias("h"))
    lower = rows.select(id_column, "h.name", "h.descriptor", F.lower("h.mention").alias("mention"))
    return lower.groupBy(id_column, "name", "descriptor", "mention").agg(F.count("*").alias("n")).select(id_column, "name", "mention", "n", "descriptor")


# ---- replacing mentions ----------------------------------------------------------------------------

LOG = "array<struct<type:string,match:string,n:bigint,replacement:string,confidence:string,category:string>>"
_FOLD = {c: c + 32 for c in range(65, 91)}  # A-Z only: no character changes its length


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


def _word_at(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i] == "_" or (text[i].isascii() and text[i].isalnum()))


def splice(text: str, mentions: Sequence[dict]) -> tuple[str, list[dict]]:
    """``text`` with the whole-word occurrences of each mention replaced by its descriptor, and a log entry per mention found.

    Longer mentions take their places first; the text is put together once, from the spans.
    """
    if not mentions:
        return text, []
    folded, taken = _folded(text), bytearray(len(text))
    spans: list[tuple[int, int, str]] = []
    log = []
    for m in sorted(mentions, key=lambda m: -len(m["mention"])):
        wanted, n, at = _folded(m["mention"]), 0, 0
        while wanted and (at := folded.find(wanted, at)) >= 0:
            end = at + len(wanted)
            whole = _word_at(text, at - 1) != _word_at(text, at) and _word_at(text, end - 1) != _word_at(text, end)
            if whole and not any(taken[at:end]):
                taken[at:end] = b"\1" * len(wanted)
                spans.append((at, end, m["descriptor"]))
                n, at = n + 1, end
            else:
                at += 1
        if n:
            log.append({"type": "company_name", "match": m["mention"], "n": n, "replacement": m["descriptor"], "confidence": m["confidence"], "category": "Client Identity"})
    out, done = [], 0
    for at, end, descriptor in sorted(spans):
        out += [text[done:at], descriptor]
        done = end
    return "".join(out) + text[done:], log


def apply_mentions(docs: DataFrame, column: str, mentions: Column) -> DataFrame:
    """Replace ``mentions`` (``mention, descriptor, confidence``) in the text and append to ``log``, in one pass over a text."""
    given = docs.withColumn("__given", mentions)
    entries = T.DataType.fromDDL(LOG)
    kind, at = to_arrow_type(entries), given.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                texts = zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())
                done = [splice(t, m) if t is not None and m is not None else (t, []) for t, m in texts]
                columns = list(part.columns[:-1])
                columns[at] = pa.array([d[0] for d in done], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], kind)], names=[*batch.schema.names[:-1], "__entries"])

    done = given.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__entries", entries)]))
    return done.withColumn("log", F.concat("log", "__entries")).drop("__entries")
