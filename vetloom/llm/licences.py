"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines with words; a line without any ends it. A multinomial logistic regression with an L1 penalty
over word n-grams (one and two words, presence only) tells licence families and ``unknown`` apart. It is trained on notices
that are varied from the templates, on the same words in another order, and on ``train_rows`` paragraphs of the corpus that
resemble no template. Two held-out sixths of these rows calibrate it: one gives a temperature for the probabilities, the
other the probability from which at most ``false_rate`` of the unknown rows would be accepted; below that a text is unknown.
A prediction counts only if the text holds enough of the word triples of one of the family's templates.

A paragraph is judged whole, and so is every group of its neighbouring lines, as long as a template at most, that begins and
ends with a line that shares a word triple with some template: notices wrapped over lines are found, and so are those that
stand among other text. Lines much longer than the templates are judged in pieces in the same way. A text without such a
triple can't be confirmed, so nothing is left out.

Only n-grams of templates are features, so a model stays small whatever the corpus. A null or empty text has no paragraphs,
an empty table no rows. Whole texts are scanned, long paragraphs whole, in time linear in the text. Repeated rows get equal
results; only the id and the text are read, so columns of any other name do no harm.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetloom.llm.decontaminate import words_of
from vetloom.llm.shared import bounded_batches, id_and_bytes

UNKNOWN = "unknown"
#: The usual public notices of each family, one paragraph each.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}


def tokens(data: bytes) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words_of(data)]


def ngrams(words: Sequence[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


def triples(words: Sequence[str]) -> set[tuple[str, ...]]:
    """Word triples; of a shorter text the text itself."""
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)}


class Templates:
    def __init__(self, templates: Mapping[str, Sequence[str]] = TEMPLATES):
        self.families = sorted(templates)
        self.words = {f: [tokens(t.encode()) for t in templates[f]] for f in self.families}
        if any(len(w) < 3 for f in self.families for w in self.words[f]):
            raise ValueError("a template needs three words or more")
        self.triples = {f: [triples(w) for w in self.words[f]] for f in self.families}
        self.all_triples = frozenset().union(*(t for f in self.families for t in self.triples[f]))
        self.longest = max(len(w) for f in self.families for w in self.words[f])
        self.features = sorted(set().union(*(ngrams(w) for f in self.families for w in self.words[f])))

    def likeness(self, family: str, words: Sequence[str]) -> float:
        """Largest share of a template's triples that stand in the text."""
        found = triples(words)
        return max(len(t & found) / len(t) for t in self.triples[family])


def paragraphs(data: bytes) -> Iterator[tuple[int, list[list[str]]]]:
    """The paragraphs of a text: the number of the first line (from 0 on), and the words of each line."""
    first, lines = 0, []
    for at, line in enumerate(data.split(b"\n")):
        words = tokens(line)
        if words:
            first = first if lines else at
            lines.append(words)
        elif lines:
            yield first, lines
            lines = []
    if lines:
        yield first, lines


def groups(lines: Sequence[Sequence[str]], templates: Templates) -> Iterator[tuple[int, int, list[str]]]:
    """Groups of neighbouring lines that may hold a notice: their first and last line, and their words.

    A line of more words than the longest template is cut into pieces of half as many. A group begins and ends with a piece
    that holds the first or the last word of a template's triple, and it ends with the piece that makes it half as long
    again as the longest template; a notice is never longer.
    """
    half = max(templates.longest // 2, 1)
    pieces: list[tuple[int, list[str]]] = []
    for at, words in enumerate(lines):
        if len(words) <= templates.longest:
            pieces.append((at, list(words)))
        else:
            pieces += [(at, list(words[i : i + half])) for i in range(0, len(words), half)]
    flat = [w for _, words in pieces for w in words]
    piece_of = [p for p, (_, words) in enumerate(pieces) for _ in words]
    starts, ends = set(), set()
    for i, triple in enumerate(zip(flat, flat[1:], flat[2:])):
        if triple in templates.all_triples:
            starts.add(piece_of[i])
            ends.add(piece_of[i + 2])
    for start in sorted(starts):
        group: list[str] = []
        for end in range(start, len(pieces)):
            group = group + pieces[end][1]
            if end in ends:
                yield pieces[start][0], pieces[end][0], group
            if len(group) >= templates.longest + half:
                break


def judge(lines: Sequence[Sequence[str]], templates: Templates, model: Model, least_likeness: float) -> tuple[bool, list[tuple[int, str]]]:
    """Whether a paragraph or a group of its lines is predicted as a licence, and the confirmed families by first line.

    Of confirmed groups of one family that share a line, the likest counts, then the shortest, then the first.
    """
    predicted = model.predict([w for words in lines for w in words])[0] != UNKNOWN
    confirmed = []
    for first, last, words in groups(lines, templates):
        family = model.predict(words)[0]
        if family != UNKNOWN:
            predicted = True
            if (likeness := templates.likeness(family, words)) >= least_likeness:
                confirmed.append((-likeness, len(words), first, last, family))
    found, taken = [], set()
    for _, _, first, last, family in sorted(confirmed):
        span = {(family, at) for at in range(first, last + 1)}
        if taken.isdisjoint(span):
            taken |= span
            found.append((first, family))
    return predicted, sorted(found)


def varied(words: list[str], others: list[str], rng: random.Random) -> list[str]:
    """A notice with a word left out at times and with words of the corpus before and behind."""
    kept = [w for w in words if rng.random() > 0.04] or words
    before, behind = (rng.choices(others, k=rng.choice((0, 0, 0, 3, 12))) if others else [] for _ in range(2))
    return [*before, *kept, *behind]


def training_rows(templates: Templates, corpus: list[list[str]], per_template: int, seed: int) -> list[tuple[list[str], str]]:
    rng = random.Random(seed)
    plain = [w for w in corpus if w and max(templates.likeness(f, w) for f in templates.families) < 0.3]
    others = [x for w in plain[:200] for x in w]
    rows = [(w, UNKNOWN) for w in plain]
    for family in templates.families:
        for words in templates.words[family]:
            rows += [(varied(words, others, rng), family) for _ in range(per_template)]
            for _ in range(per_template // 2):
                mixed = rng.sample(words, len(words))
                if templates.likeness(family, mixed) < 0.3:
                    rows.append((varied(mixed, others, rng), UNKNOWN))
    rng.shuffle(rows)
    return rows


@dataclass
class Model:
    families: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def scores(self, words: Sequence[str]) -> np.ndarray:
        active = [x for x in map(self.weights.get, ngrams(words)) if x is not None]
        return self.bias + np.sum(active, axis=0) if active else self.bias

    def predict(self, words: Sequence[str]) -> tuple[str, float]:
        return self.decide(self.scores(words))

    def decide(self, scores: np.ndarray) -> tuple[str, float]:
        scaled = np.exp((scores - scores.max()) / self.temperature)
        best = int(scaled.argmax())
        chance = float(scaled[best] / scaled.sum())
        family = self.families[best]
        return (family, chance) if family == UNKNOWN or chance >= self.least else (UNKNOWN, 1 - chance)


def fit(spark: SparkSession, rows: list[tuple[list[str], str]], templates: Templates, false_rate: float = 0.002, penalty: float = 0.0005) -> Model:
    """A calibrated model of bounded training rows: two thirds train it, a sixth gives the temperature, a sixth the threshold."""
    families = [UNKNOWN, *templates.families]
    place = {f: i for i, f in enumerate(templates.features)}
    cut = len(rows) * 2 // 3

    def vector(words: list[str]) -> SparseVector:
        return SparseVector(len(place), {place[g]: 1.0 for g in ngrams(words) if g in place})

    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    train = spark.createDataFrame([(float(families.index(label)), vector(words)) for words, label in rows[:cut]], schema).coalesce(2)
    learner = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    learned = learner.fit(train)
    matrix = learned.coefficientMatrix.toArray().T
    weights = {f: matrix[i] for f, i in place.items() if np.any(matrix[i])}
    model = Model(families, weights, learned.interceptVector.toArray())
    held = rows[cut:]
    all_scores = np.array([model.scores(words) for words, _ in held])
    all_truth = np.array([families.index(label) for _, label in held])
    scores, truth = all_scores[::2], all_truth[::2]

    def loss(temperature: float) -> float:
        z = scores / temperature
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

    model.temperature = min(np.geomspace(0.2, 5, 41), key=loss)
    model.least = 0.0
    scores, truth = all_scores[1::2], all_truth[1::2]
    wrong = sorted((c for s, t in zip(scores, truth) if t == 0 for f, c in [model.decide(s)] if f != UNKNOWN), reverse=True)
    allowed = int(false_rate * np.count_nonzero(truth == 0))
    model.least = max(0.5, np.nextafter(wrong[allowed], 2) if len(wrong) > allowed else 0.0)
    return model


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Templates | None = None, train_rows: int = 3_000, per_template: int = 60, seed: int = 6
) -> Model:
    """A model for the corpus ``docs``, from its templates and at most ``train_rows`` of its paragraphs under 4,000 code points.

    The paragraphs are those of the smallest hashes of id and text, so neither files nor partitions decide which they are.
    They are counted first: only hashes below a bound that about twice ``train_rows`` of them meet are sorted and collected.
    """
    templates = templates or Templates()
    blocks = docs.select(F.col(id_col).alias("id"), F.explode(F.split(text_col, "\n[\\x20\\x09-\\x0D]*\n")).alias("block"))
    fit_for = blocks.where((F.length("block") > 0) & (F.length("block") < 4_000))
    count = fit_for.count()
    least = -(1 << 63)
    bound = least + (1 << 64) * 2 * train_rows // count if count > 2 * train_rows else (1 << 63) - 1
    low = fit_for.withColumn("hash", F.xxhash64("id", "block")).where(F.col("hash") <= F.lit(bound).cast("long"))
    some = low.orderBy("hash", "block").limit(train_rows).select("block").collect()
    corpus = sorted(tokens(r["block"].encode()) for r in some)
    return fit(docs.sparkSession, training_rows(templates, corpus, per_template, seed), templates)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Templates | None = None, model: Model | None = None, least_likeness: float = 0.6) -> DataFrame:
    """Per document: its paragraphs, those predicted as a licence, those confirmed, and the confirmed families.

    ``spans`` names each confirmed place as ``line:family``, by the first line of its group (lines from 0 on).
    """
    templates = templates or Templates()
    bounded_batches(docs.sparkSession)
    model = model or train(docs, id_col, text_col, templates)
    share = docs.sparkSession.sparkContext.broadcast((templates, model))  # as large as the templates make it
    rows = id_and_bytes(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classifier = share.value
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_paragraphs", "n_predicted", "n_confirmed", "families", "spans")}
            for data in batch.column(1):
                n_paragraphs = n_predicted = n_confirmed = 0
                confirmed = []
                for first, lines in paragraphs(data.as_py()):
                    predicted, found = judge(lines, known, classifier, least_likeness)
                    n_paragraphs, n_predicted, n_confirmed = n_paragraphs + 1, n_predicted + predicted, n_confirmed + bool(found)
                    confirmed += [(first + at, f) for at, f in found]
                out["n_paragraphs"].append(n_paragraphs)
                out["n_predicted"].append(n_predicted)
                out["n_confirmed"].append(n_confirmed)
                out["families"].append(",".join(sorted({f for _, f in confirmed})))
                out["spans"].append(",".join(f"{at}:{f}" for at, f in confirmed))
            columns = [pa.array(v, pa.int64() if n.startswith("n_") else pa.string()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *out])

    return rows.mapInArrow(run, f"doc_id {kind}, n_paragraphs long, n_predicted long, n_confirmed long, families string, spans string")
