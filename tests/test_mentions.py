"""Dictionary names in texts: the automaton, the joins beyond its size, brute force, and the splice of spans."""

import random
import re

import pytest

from vetloom.operators import mentions as M

TEXTS = [
    (1, "Acme Union Holdings hired. We saw Acme. Union of Acme-Union (Pty) Ltd"), (2, "Red ring and red ring box, blue ring"), (3, "no names"), (4, None),
    (5, "ACME UNION LTD, acme union ltd; Acme Union Limitedx acme  union"), (6, "red ring box ltd red ring"), (8, "Blue Ring Group"), (7, "x_red ring red ringing"),
]
FOUND = {
    (1, "Acme Union", "acme union holdings", 1), (8, "Blue Ring", "blue ring group", 1), (2, "Red Ring", "red ring", 1), (2, "Red Ring Box", "red ring box", 1),
    (2, "Blue Ring", "blue ring", 1), (5, "Acme Union", "acme union ltd", 2), (5, "Acme Union", "acme union", 1), (6, "Red Ring Box", "red ring box ltd", 1), (6, "Red Ring", "red ring", 1),
}
NAMES = [("Red Ring", "a"), ("Red Ring Box", "b"), ("Blue Ring", "c"), ("Acme Union", "d")]
BOTH_WAYS = [M.DICTIONARY_BYTES, -1]


@pytest.mark.parametrize("limit", BOTH_WAYS)
def test_mentions_are_the_same_on_both_sides_of_the_size_check(spark, limit):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    for names in (NAMES, NAMES + [(f"Zq{i} Works", "e") for i in range(2_000)]):
        got = M.dictionary_mentions(docs, spark.createDataFrame(names, "name string, descriptor string"), "doc_id", "text", limit=limit)
        assert {(r["doc_id"], r["name"], r["mention"], r["n"]) for r in got.collect()} == FOUND
    assert M.dictionary_mentions(docs, spark.createDataFrame([], "name string, descriptor string"), "doc_id", "text", limit=limit).count() == 0


def plain_hits(text, names):
    """Every place, every name, by regular expressions; the longest at a place, then left to right."""
    best = {}
    for name, descriptor in names:
        for m in re.finditer(rf"(?=(?<![A-Za-z0-9_]){re.escape(name.lower())}(?![A-Za-z0-9_]))", (text or "").lower()):
            best[m.start()] = max(best.get(m.start(), (0,)), (len(name), name, descriptor))
    out, free = [], 0
    for at in sorted(best):
        if at >= free:
            size, name, descriptor = best[at]
            ending = next((e for e in M.CORPORATE_ENDINGS if re.match(re.escape(e.lower()) + "(?![A-Za-z0-9_])", text[at + size :].lower())), "")
            free = at + size + len(ending)
            out.append((name, descriptor, text[at:free]))
    return out


@pytest.mark.parametrize("limit", BOTH_WAYS)
def test_hits_equal_brute_force(spark, limit):
    rng = random.Random(3)
    vocabulary = ["the", "Ltd", "Group", "a", "b", "c", "Holdings", "ü"]
    names = sorted({" ".join(rng.choices(vocabulary[:-1], k=rng.choice((1, 2, 2, 3, 5)))) for _ in range(60)}) + ["a-b", "a, the", "b.c"]
    names = [(n, f"d{i % 7}") for i, n in enumerate(names)]
    names += [(names[0][0], "zz"), (None, "null"), ("(odd)", "x"), ("", "y"), (names[1][0].upper(), "a")]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "-", ", ", ".", "  ", "\n"]) for _ in range(rng.choice((0, 3, 40))))) for i in range(150)]
    rows += [(900, "the " * 3000), (901, None), (None, "a b c"), (902, "a" * 10_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    frame = spark.createDataFrame(names, "name string, descriptor string")
    got = {r.doc_id: [(h.name, h.descriptor, h.mention) for h in r.hits] for r in M.mention_hits(docs, frame, "doc_id", "text", limit=limit).collect()}
    grams = {}
    for name, descriptor in names:
        if name and re.fullmatch(r"[A-Za-z0-9_](.*[A-Za-z0-9_])?", name):
            grams[name.lower()] = max(grams.get(name.lower(), ("", "")), (name, descriptor))
    want = {i: plain_hits(t, list(grams.values())) for i, t in rows if t}
    assert got == {i: h for i, h in want.items() if h}
    with_all = M.with_hits(docs, "doc_id", "text", frame, limit=limit)
    assert with_all.count() == len(rows) and with_all.where("__hits is null").count() == 0


def test_a_bounded_dictionary_shuffles_no_text(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    plan = M.with_hits(docs, "doc_id", "text", spark.createDataFrame(NAMES, "name string, descriptor string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_splice_takes_longer_mentions_first_and_whole_words_only():
    def m(mention, descriptor):
        return {"mention": mention, "descriptor": descriptor, "confidence": "high"}

    text, log = M.splice("Acme and ACME Works, not Acmes; acme works_ or Éacme", [m("Acme", "A firm"), m("acme works", "a plant"), m("absent", "x"), m("", "y")])
    assert text == "A firm and a plant, not Acmes; A firm works_ or ÉA firm"
    assert [(e["match"], e["n"]) for e in log] == [("acme works", 1), ("Acme", 3)]
    assert M.splice("", [m("a", "b")]) == ("", []) and M.splice("a a", []) == ("a a", [])
    long = "word " * 50_000
    assert M.splice(long, [m("word", "w")])[0] == "w " * 50_000
