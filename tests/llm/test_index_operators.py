"""Lexical search, digest index and prefix trie against brute force, and their edge rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from vetloom.llm import exact_dedup, lexical_search, prefix_trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return collections.Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def plain_ranks(docs, items, k):
    texts = [(i, plain_terms(t)) for i, t in docs if plain_terms(t)]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = collections.Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts in texts:
            norm = 50 + (50 * sum(counts.values()) * n) // total
            score = 0
            for t in plain_terms(text):
                if tf := counts.get(t, 0):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * norm))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, at + 1, doc, -score) for at, (score, _, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_brute_force(spark, monkeypatch, edge_docs, edge_rows, no_docs, tmp_path, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "日本", "Ab", "aB"]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(len(vocabulary))], k=rng.choice((1, 20, 400))))) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(5, rows[7][1]), (None, rows[7][1]), (None, None), (9, ""), (9, "?!")]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(30)] + [(3, rows[7][1]), (3, rows[7][1]), (None, "w1 W2, w3"), (77, None), (78, "nowhere")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "PASS_QUERIES", 20)  # several passes
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 64)
    monkeypatch.setattr(lexical_search, "COUNTED", 100)
    got = lexical_search.rank(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), queries, k)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranks(rows, items, k)
    edge = [(r[0], r[1]) for r in edge_rows]
    got = lexical_search.rank(edge_docs, queries.union(edge_docs.select("doc_id", "text")), k)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranks(edge, items + edge, k)
    assert lexical_search.rank(no_docs, queries, k).isEmpty() and lexical_search.rank(edge_docs, queries.limit(0), k).isEmpty()


def test_bounds_are_never_below_scores_and_leave_most_documents_out():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (j + 5) for j in range(2000)], k=200)).encode() for _ in range(512)]
    held = [(i, i, 200, *lexical_search._signature_keys(lexical_search.terms(t))) for i, t in enumerate(texts)]
    block = lexical_search._block(held, 8 * 512)
    weighed = [type("Row", (), {"uid": q, "term": t, "weight": 1000})() for q in range(20) for t in set(texts[q].split()[:20])]
    asked = lexical_search._Queries(weighed, 512, 512 * 200)
    bounds = asked.bounds(8 * 512, np.full(512, 200), block["slices"])
    norm, left = int(asked.norms(np.array([200]))[0]), 0
    for q in range(20):
        exact = np.zeros(512, dtype=np.int64)
        for d, text in enumerate(texts):
            counts = lexical_search.terms(text)
            exact[d] = sum(w * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * norm)) for t, w in asked.by_uid[q] if counts[t])
        assert (bounds[q] >= exact).all()
        left += int((bounds[q] < np.sort(exact)[-10]).sum())
    assert left > 0.8 * 20 * 512


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_classes(rows):
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[normal(text)].append(key)
    out = []
    for text, keys in groups.items():
        keys.sort(key=lambda x: (x is None, x or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(key, keys[0], len(keys), at == 0, digest) for at, key in enumerate(keys)]
    return sorted(out, key=str)


def test_digest_report_equals_brute_force(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(4)
    rows = [(rng.randrange(500), rng.choice(["a  b", "a\tb", "a b", " a b", "A b", f"t{rng.randrange(300)}"])) for _ in range(2000)]
    rows += [(i, "the copy that is everywhere\n" + " " * (i % 3)) for i in range(1000, 2500)]
    for frame, plain in ((spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows), (edge_docs, [(r[0], r[1]) for r in edge_rows])):
        got = sorted((tuple(r) for r in exact_dedup.report(frame).collect()), key=str)
        assert got == plain_classes(plain)
    assert exact_dedup.report(no_docs).isEmpty()
    names = spark.createDataFrame([("b", "x"), ("a", "x "), (None, "x ")], "doc_id string, text string")
    kept = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.report(names).collect()}
    assert kept == {("b", "b", True), ("a", "a", True), (None, "a", False)}


def test_index_outlives_the_session_and_repeated_deliveries(spark, edge_docs, edge_rows, tmp_path):
    path = f"{tmp_path}/index"
    first = spark.createDataFrame([(5, "one", 1), (6, "two", 2), (4, "one ", 3), (6, "two", 2)], "doc_id long, text string, id int")
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    assert sorted(exact_dedup.new_documents(index, first, "monday").collect()) == [(4, "one ", 3), (5, "one", 1), (6, "two", 2)]
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    later = spark.createDataFrame([(1, "one", 1), (2, "three", 2), (3, "one\t", 3), (2, "three", 1)], "doc_id long, text string, id int")
    taken = exact_dedup.new_documents(again, later, "tuesday").collect()
    assert [r.doc_id for r in taken] == [2]
    assert exact_dedup.new_documents(again, later, "tuesday").collect() == taken  # a repeated delivery changes nothing
    packed = again.compact(f"{tmp_path}/packed")
    assert sorted(packed.read().collect(), key=str) == sorted(again.read().collect(), key=str) and packed.read().count() == 4
    assert exact_dedup.new_documents(packed, first, "wednesday").isEmpty()
    edge = exact_dedup.new_documents(exact_dedup.DigestIndex(spark, f"{tmp_path}/edge"), edge_docs, "all")
    assert edge.columns == edge_docs.columns
    assert collections.Counter(normal(r.text) for r in edge.collect()) == collections.Counter({normal(r[1]) for r in edge_rows})


def test_digest_index_uses_no_python_and_no_gathering(spark, edge_docs):
    plan = exact_dedup.report(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|collect_|Window|NestedLoop|Cartesian", plan)


def plain_trie(rows, group=20, most=4):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turns in own.items():
        if conv is not None:
            head = zlib.crc32(str(conv).encode()) % most
            turns = own.get(conv - int(math.fmod(conv, group)), [])[:head] + turns[head:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        if path:
            saved[path] += (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1]))
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]

    def least(path):
        return min((c for c in members[path] if c is not None), default=None)

    def digest(path):
        return hashlib.sha256(",".join(map(str, sorted(c for c in ends[path] if c is not None))).encode()).hexdigest()

    return sorted(
        ((least(p), len(p), least(p[:-1]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()), key=str
    )


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-50, 20_000), 400):
        for turn in range(rng.choice((1, 2, 3, 5, 9))):
            rows.append((conv, turn, rng.choice(("user", "assistant", None)), " ".join(["hello"] * rng.choice((0, 1, 1, 1, 3)))))
    rows += [(100_000 + i, t, "user", "hello") for i in range(150) for t in range(2)]
    rows += [(20, None, "user", "null turn"), (20, 0, None, None), (None, 1, "user", "hello"), (None, 0, "user", "x"), (7, 3, "a", "tie"), (7, 3, "a", "tie")]
    rows += [(999_999, t, "user", f"long {t}") for t in range(700)]
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    if seed % 2:
        monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", -1)
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, seq string").repartition(7)
    got = prefix_trie.report(frame).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_trie_of_one_and_of_no_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.report(spark.createDataFrame([], schema)).isEmpty()
    for rows in ([(20, 0, "user", "a b")], [(None, None, None, None)], [(19, 0, "u", "x")]):
        assert sorted(map(tuple, prefix_trie.report(spark.createDataFrame(rows, schema)).collect()), key=str) == plain_trie(rows)


def test_extents_of_range_minima():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 100):
        values = rng.integers(0, 4, n)
        table = prefix_trie.RangeMinimum(values)
        at, bound = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        left, right = table.first_left(at, bound), table.last_right(at, bound)
        for i, b, low, high in zip(at, bound, left, right):
            a = i
            while a >= 1 and values[a] >= b:
                a -= 1
            z = i
            while z + 1 < n and values[z + 1] >= b:
                z += 1
            assert (a, z) == (low, high)
