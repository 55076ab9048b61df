"""Operators that look across rows: SimHash, line dedup, sharding, WARC, components, and the pipeline."""

import collections
import itertools
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from vetloom.llm import graph, line_dedup, quality, sharding, simhash, warc


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# SimHash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_of_edge_rows(edge_docs, no_docs, edge_rows):
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edge_docs).collect())
    prints = [plain_fingerprint(r[1]) for r in edge_rows]
    root = roots(len(prints), [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    least = {x: min((edge_rows[i][0] for i, y in enumerate(root) if y == x and edge_rows[i][0] is not None), default=None) for x in set(root)}
    assert got == collections.Counter((r[0], f"{p:016x}", least[x]) for r, p, x in zip(edge_rows, prints, root))
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("bucket_rows", [1 << 17, 40])
def test_links_lose_nothing_when_buckets_are_dealt_again(spark, bucket_rows):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = set(seeds) | {0, (1 << 64) - 1}
    for s in seeds[:20]:
        for _ in range(30):
            s ^= 1 << rng.randrange(64)
            fps.add(s)
    fps |= {seeds[0] ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)}  # a dense group
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, 3, bucket_rows).collect()]
    at = {f: i for i, f in enumerate(fps)}
    want = roots(len(fps), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert all(want[at[a]] == want[at[b]] for a, b in edges)
    assert roots(len(fps), [(at[a], at[b]) for a, b in edges]) == want
    if bucket_rows > len(fps):
        assert len(edges) < 4 * len(fps)  # one star per bucket, never all pairs


def test_search_splits_when_too_much_is_open(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    fps = np.array(sorted({1 << a | 1 << b for a in range(30) for b in range(30)}), dtype=np.uint64)
    moved, to = simhash.GrayIndex(fps, np.zeros(len(fps), dtype=np.int64)).links(3)
    assert len(moved) == len(fps) - 1 and set(to.tolist()) == {0}


def test_keep_one_of_each_group(spark, edge_docs, no_docs, edge_rows):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    prints = [plain_fingerprint(r[1]) for r in edge_rows]
    root = roots(len(prints), [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    group = {(r[0], r[1]): x for r, x in zip(edge_rows, root)}
    least = {x: min((r[0] is None, r[0] or 0) for r, y in zip(edge_rows, root) if y == x) for x in set(root)}
    rows = kept.collect()
    assert collections.Counter(group[r.doc_id, r.text] for r in rows) == collections.Counter(least.keys())
    assert all((r.doc_id is None, r.doc_id or 0) == least[group[r.doc_id, r.text]] for r in rows)
    assert simhash.keep_one(no_docs).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "e f g h i")], "doc_id long, text string")
    assert simhash.keep_one(nulls).count() == 2


def test_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 70)] + [(100, 100 + i) for i in range(1, 80)] + list(itertools.combinations(range(300, 312), 2))
    pairs += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(500, pairs)
    assert got == {i: r for i, r in enumerate(want) if r != i}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# line dedup


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_removed(rows, least=20):
    """Line numbers that go, per row; rows of one id and text share places."""
    places = {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" "):
                places.setdefault(line, (doc, text, at))
    order = {line: k for k, line in enumerate(sorted(places, key=lambda x: (places[x][0] is None, places[x][0] or 0, places[x][2])))}
    near = {x for x, y in itertools.permutations(places, 2) if order[y] < order[x] and min(len(x), len(y)) >= least and one_edit(x, y)}
    out = []
    for doc, text in rows:
        lines = text.split("\n") if text is not None else []
        gone = [at for at, x in enumerate(lines) if x in places and (x in near or places[x] != (doc, text, at))]
        out.append((doc, len(lines), len(gone), ",".join(map(str, gone))))
    return out


def near_lines():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdé😀 ") for _ in range(rng.choice((20, 21, 35)))) + "z" for _ in range(12)]
    lines = []
    for line in base:
        lines += [line, line]
        for _ in range(4):
            i = rng.randrange(len(line))
            lines.append(rng.choice((line[:i] + line[i + 1 :], line[:i] + "q" + line[i:], line[:i] + "q" + line[i + 1 :], line[:i] + "qq" + line[i:])))
    lines += ["aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "short", "short", "shorter", "}", "}", "}", "a" * 19 + "b", "a" * 18 + "b", " " * 25, " " * 25, "", "\t" * 30, "\t" * 30]
    rng.shuffle(lines)
    return [(d, "\n".join(lines[d * 4 : d * 4 + 4])) for d in range(len(lines) // 4 + 1)]


def test_line_dedup_equals_brute_force(spark):
    rows = near_lines()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, at int")
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in line_dedup.removed_lines(frame).collect())
    assert got == collections.Counter(brute_removed(rows))
    texts = {r.doc_id: r.text for r in line_dedup.drop_lines(frame).collect()}
    for doc, _, _, gone in brute_removed(rows):
        kept = [x for i, x in enumerate(rows[doc][1].split("\n")) if str(i) not in gone.split(",")]
        assert texts[doc] == "\n".join(kept)


def test_line_dedup_of_edge_rows(spark, edge_docs, no_docs, edge_rows):
    pairs = [(r[0], r[1]) for r in edge_rows if r[0] != 6]  # two texts under one id are ordered by a hash
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in line_dedup.removed_lines(frame).collect())
    assert got == collections.Counter(brute_removed(pairs))
    out = line_dedup.drop_lines(edge_docs, size_col="n_chars")
    assert out.columns == edge_docs.columns and out.dtypes == edge_docs.dtypes and out.count() == edge_docs.count()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert line_dedup.removed_lines(no_docs).count() == 0 and line_dedup.drop_lines(no_docs).count() == 0


# sharding


def test_table_is_balanced_and_moves_little():
    now = sharding.fill_table({f"s{i}": 1 for i in range(10)}, 4099)
    then = sharding.fill_table({f"s{i}": 1 for i in range(11)}, 4099)
    counts = collections.Counter(now)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sum(a != b for a, b in zip(now, then)) < 0.3 * 4099
    weighted = collections.Counter(sharding.fill_table({"a": 3, "b": 1}, 401))
    assert abs(weighted["a"] - 3 * weighted["b"]) <= 4
    for shards, size in (({}, 7), ({"a": 1}, 8), ({"a": 0}, 7), ({"a": 9}, 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, size)


def test_placement_of_edge_rows(edge_docs, no_docs, tmp_path, spark):
    shards = {"a": 1, "b": 2}
    placed = sharding.place(edge_docs, "doc_id", shards, 101).collect()
    table = sharding.fill_table(shards, 101)
    number = lambda key: sharding._number("" if key is None else str(key)) % 101
    assert len(placed) == edge_docs.count() and all(r.slot == number(r.row.doc_id) and r.shard == table[r.slot] for r in placed)
    sharding.write(edge_docs, "doc_id", shards, str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == edge_docs.count()
    assert sharding.plan_growth(no_docs, "doc_id", shards, {**shards, "c": 1}, 101).count() == 0


def test_sharding_and_line_dedup_run_no_python(spark, edge_docs):
    for frame in (sharding.place(edge_docs, "doc_id", {"a": 1}, 7), line_dedup.removed_lines(edge_docs)):
        plan = frame._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# WARC


def page_rows():
    return [
        (1, "http://a.org/x?y#z", "<p>é</p>"), (2, "http://b.org", "<p>é</p>"), (3, None, "<p>é</p>"), (4, "http://c.org/\r\nX: y", ""), (5, "u", None),
        (6, "http://d.org/", "line\r\n\r\nWARC/1.1\r\n\r\nbody" * 50), (7, "http://d.org/", "x" * 300_000), (7, "http://d.org/", "x" * 300_000), (None, "n", "<p>é</p>"), (None, "n", "only"),
    ]


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back_from_archives(spark, least):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, copy int")
    got = warc.page_captures(pages, least=least).collect()
    want = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        again = len(data) >= least and top is not None and page != top
        want[page, len(data), warc.base32_sha1(data), "revisit" if again else "response", top if again else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.page_captures(pages.limit(0)).count() == 0


def test_records_are_linked_in_either_direction(spark):
    rows = [
        ("r1", "response", []), ("q1", "request", ["r1"]), ("m1", "metadata", ["r1"]), ("m2", "metadata", ["r1"]), ("q2", "request", []), ("r2", "revisit", ["q2"]),
        ("r3", "response", []), ("q3", "request", ["gone"]), ("i", "warcinfo", []), ("r1x", "response", ["q1x", "q1x"]), ("q1x", "request", ["r1x"]),
    ]
    records = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], warc.RECORD.rpartition(", payload")[0])
    got = {(r.capture and r.capture.record_id, r.request and r.request.record_id, r.metadata and r.metadata.record_id, r.n_requests, r.n_metadata) for r in warc.assemble(records).collect()}
    assert got == {("r1", "q1", "m1", 1, 2), ("r2", "q2", None, 1, 0), ("r3", None, None, 0, 0), ("r1x", "q1x", None, 1, 0), (None, "q3", None, 1, 0)}


def test_archives_hold_whole_payloads(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    archives = warc.write_archives(pages, str(tmp_path / "warc"))
    payloads = [bytes(r.payload) for r in warc.read_records(archives, with_payload=True).where("kind = 'response'").collect()]
    assert sorted(set(payloads)) == sorted({(h or "").encode() for _, _, h in page_rows()})


# the pipeline


@pytest.mark.parametrize("rows", ["edge", "none"])
def test_stages_keep_the_columns_and_handle_edge_rows(spark, edge_docs, no_docs, tmp_path, rows):
    docs = edge_docs if rows == "edge" else no_docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / f"{k}"))
        out = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        docs = out


def test_each_stage_alone_on_edge_rows(spark, edge_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert 0 < stage(spark, edge_docs, "/root/testdata/sf0.001").count() <= edge_docs.count() or name == "quality_rules", name


def test_run_equals_its_stages_one_by_one(spark):
    directory = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, directory).collect()}
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    kept = {r.doc_id for r in quality.measure(docs).where("kept").collect()}
    assert got and {d for d, _ in got} <= kept
