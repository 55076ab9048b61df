"""Operators that judge one text at a time: secrets, tokens, quality, licences, decontamination, urls."""

import collections
import hashlib
import math
import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vetloom.llm import bpe, decontaminate, licences, quality, secret_scan, url_trie

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = bpe.Vocabulary(bpe.load_ranks(RANK_FILE))
PATTERN = regex.compile(public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# byte-level BPE


def ids_of(text):
    return np.frombuffer(bpe.encode_texts([text], PATTERN, VOCABULARY, {})[0], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abtheinrs \n'1é日ß-=😀"), max_size=120))
def test_bpe_equals_the_library_and_decodes(text):
    ids = ids_of(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert VOCABULARY.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "".join(random.Random(2).choices("aeiorst", k=20_000)), "\x00" * 500])
def test_bpe_of_very_long_pre_tokens(text):
    assert ids_of(text).tolist() == LIBRARY.encode_ordinary(text)


def test_rank_queue_gives_the_lowest_rank_first():
    queue, rng = bpe.RankQueue(50_256), random.Random(4)
    ranks = [rng.randrange(50_256) for _ in range(3_000)]
    for i, rank in enumerate(ranks):
        queue.push(rank, np.array([i]))
    seen = []
    while (item := queue.pop()) is not None:
        seen.append(item[0])
        assert sorted(item[1].tolist()) == [i for i, r in enumerate(ranks) if r == item[0]]
    assert seen == sorted(set(ranks))


def test_bpe_edge_rows(edge_docs, no_docs, edge_rows):
    got = bpe.round_trip(edge_docs, RANK_FILE, public_tokenizers.PATTERN).collect()
    want = collections.Counter((r[0], len(LIBRARY.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in edge_rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == want
    assert bpe.round_trip(no_docs, RANK_FILE, public_tokenizers.PATTERN).collect() == []


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "The café"), (2, None), (3, "")], "doc_id long, text string")
    ids = bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in bpe.decode(ids, RANK_FILE).collect()} == {1: "The café".encode(), 2: b"", 3: b""}


# quality


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_of_edge_rows(edge_docs, no_docs, edge_rows):
    got = quality.measure(edge_docs).collect()
    want = collections.Counter((r[0], *counted(r[1] or "")) for r in edge_rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (r.base_failed <= (not r.kept)) for r in got)
    assert quality.measure(no_docs).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60))
def test_repeated_windows(words):
    assert quality.repeated_words([w.encode() for w in words]) == counted(" ".join(words))[4]


def test_repeated_windows_when_sums_collide(monkeypatch):
    monkeypatch.setattr(quality, "FACTORS", np.zeros(8, dtype=np.uint64))
    words = [w.encode() for w in "a b c d e f g h i j a b c d e f g h x y".split()]
    assert quality.repeated_words(words) == 16


def test_cascade_stops_at_the_first_rejection_and_orders_by_rate(spark):
    asked = []
    rules = [quality.Rule("slow", lambda m: asked.append("slow") or False), quality.Rule("quick", lambda m: asked.append("quick") or True)]
    assert not quality.passes(quality.Measured(b"x"), rules[::-1]) and asked == ["quick"]
    docs = spark.createDataFrame([(i, "one two") for i in range(50)], "doc_id long, text string")
    never, always = quality.Rule("never", lambda m: False), quality.Rule("always", lambda m: True)
    assert [r.name for r in quality.estimate(docs, "text", [never, always])] == ["always", "never"]


def test_keep_leaves_clean_rows_as_they_are(edge_docs, no_docs):
    kept = quality.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == quality.measure(edge_docs).where("kept").count() > 0
    assert all(quality.passes(quality.Measured(r.text.encode()), quality.RULES) for r in kept.collect())
    assert quality.keep(no_docs).count() == 0


# decontamination


def windows_of(benchmark):
    found = collections.defaultdict(set)
    for item, text in benchmark:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            found[tuple(words[i : i + size])].add("null" if item is None else str(item))
    return found


def brute_report(text, found):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    covered, items = set(), set()
    for size in {len(w) for w in found}:
        for i in range(len(words) - size + 1):
            if (key := tuple(words[i : i + size])) in found:
                covered.update(range(i, i + size))
                items |= found[key]
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(words), len(covered), len(items), digest, len(covered) > 0 and 20 * len(covered) >= len(words)


@pytest.mark.parametrize("block_words", [500_000, 20, 3])
def test_decontamination_equals_brute_force(spark, edge_rows, block_words, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block_words, 13))
    rng = random.Random(5)
    words = "a b c d e The OF x".split()
    items = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 3, 13, 14, 40))))) for i in range(8)]
    items += [(3, "repeated id but other words a b c d e a b c d e"), (None, "a b c a b c a"), (9, None), (10, ""), (11, items[5][1])]
    texts = [" ".join(rng.choices(words + ["zzz"], k=80)) + " " + (items[k % 8][1] + ", ") * (k % 3) for k in range(30)]
    docs = [(r[0], r[1]) for r in edge_rows] + [(100 + i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, n_words long")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    found = windows_of(items)
    got = decontaminate.report(frame, bench).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == collections.Counter(
        (d, *brute_report(t, found)) for d, t in docs
    )
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(not brute_report(t, found)[4] for _, t in docs)


def test_longest_matches_and_their_places(spark):
    item = [f"w{i}" for i in range(40)]
    text = ["x", *item[5:30], "y", *item[:13]]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    rows = decontaminate.matches(docs, bench).collect()
    assert sorted((r.item_id, r.doc_word, r.item_word, r.length) for r in rows) == [("7", 1, 5, 25), ("7", 27, 0, 13)]
    assert decontaminate.report(docs, bench).first().longest_match == 25


def test_decontamination_with_empty_tables(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.report(edge_docs, none).collect())
    assert decontaminate.report(no_docs, none).count() == 0 and decontaminate.matches(no_docs, none).count() == 0


# secrets


def brute_base(text):
    names = r"(?:password|passwd|secret|token|api_?key)"
    spans = []
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append(("assign", *m.span()))
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_spans(spark, edge_rows):
    texts = [
        'é PassWord = "abcdef1" token: abc secret:abcdef', "AKIA" + "A" * 16 + " AKIA123", "x" + "0a" * 12 + " " + "f" * 23, "password: token: abcdef12",
        'api_key=x; apikey = "k_1234567"', 'password = "x9$Kq2!vLp8z"', "https://joe:x9$Kq2!vLp8z@host/", "secret: changeme", 'pwd: "password1"',
    ]
    rows = [(i, t, 0) for i, t in enumerate([*texts, *(r[1] for r in edge_rows)])]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, spans int"), RANK_FILE).collect()}
    for i, text, _ in rows:
        base = brute_base(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(filter(None, got[i].spans.split(",")))
    assert got[5].spans == "guess:12:24" and got[6].spans == "guess:12:24"
    assert got[7].n_guess == 0 and got[8].n_guess == 0


def test_guess_bits_find_the_cheapest_segmentation():
    ranks = {"correct": 10, "horse": 20, "password": 1}
    bits = lambda text: secret_scan.guess_bits(text, ranks)
    assert bits("") == 0
    assert bits("password") < bits("Password") < bits("paSsWord") < bits("qzjxkvbw")
    assert bits("correcthorse") < 12 and bits("abababababab") < 15 and bits("2019-05-12") < 20 and bits("qwertyuiop") < 20
    assert bits("a" * 5_000) < 25 and bits("p@ssword") < 5


def brute_bits(text, ranks):
    """The cheapest of all segmentations, each segment priced from its text alone."""
    n, keys = len(text), text.lower().translate(secret_scan.SHIFTED)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        dates = secret_scan._date_ends(text, i) if text[i].isdigit() else []
        for j in range(i + 1, n + 1):
            part = text[i:j]
            prices = [sum(map(secret_scan._char_bits, part)), *(b for e, b in dates if e == j)]
            if len(part) > 1 and (word := secret_scan._word_bits(part, ranks)) is not None:
                prices.append(word)
            if len(part) > 2 and all(keys[k] in secret_scan.NEAR_KEYS.get(keys[k - 1], ()) for k in range(i + 1, j)):
                prices.append(math.log2(47 * 6) + len(part) - 2 + 2 * sum(keys[k - 2] == keys[k] for k in range(i + 2, j)))
            for size in range(1, min(8, len(part) // 2) + 1):
                unit, times = part[:size], len(part) // size
                if len(part) > 2 and part == unit * times:
                    prices.append(min(sum(map(secret_scan._char_bits, unit)), secret_scan._word_bits(unit, ranks) or math.inf) + math.log2(times))
            best[j] = min(best[j], best[i] + (i > 0) + min(prices))
    return best[n]


def test_guess_bits_equal_the_minimum_over_all_segmentations():
    ranks = {"hunter": 5, "dragon": 9, "horse": 20, "abc": 3, "ab": 7}
    rng = random.Random(3)
    parts = "a b ab asdf qwerty 12 03-12-89 1999 hunter 99 - x aaa abab 010203 A".split()
    texts = ["asdfghunter", "x9asdfghunter7", "aaadragonqwertyhorse", ""] + ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(800)]
    for text in texts:
        assert math.isclose(secret_scan.guess_bits(text, ranks), brute_bits(text, ranks)), text
    assert secret_scan.guess_bits("x9asdfghunter7", ranks) < 35 and secret_scan.guess_bits("03-12-89", {}) < 20


def test_values_in_wider_credential_places():
    value = "x9Kq2wvLp8zQ4"
    found = lambda text: [text[a:b] for k, a, b in secret_scan.spans(text, {"understanding": 900}, 35)[1] if k == "guess"]
    for form in ("Authorization: Bearer {}", "redis://:{}@host", "pwd  =   {}", '{{"Authorization": "Basic {}"}}', "curl -H 'bearer {}'", "passcode => '{}'"):
        assert found(form.format(value)) == [value], form
    assert found("a basic understanding") == found("the bearer has a token") == []
    text = "secret: abcdef12 " * 20_000 + f"pwd = {value}"
    base, spans = secret_scan.spans(text, {}, 35)
    assert len(base) == 20_000 and len(spans) == 20_001


def test_secrets_of_an_empty_table(no_docs):
    assert secret_scan.scan(no_docs, RANK_FILE).count() == 0


# licences


def test_licences_by_held_out_accuracy_and_templates(spark, edge_docs, no_docs):
    templates = licences.Templates()
    rng = random.Random(1)
    corpus = [[rng.choice("tions hean the of and work under version public general terms".split()) for _ in range(25)] for _ in range(300)]
    model = licences.fit(spark, licences.training_rows(templates, corpus, 40, 6), templates)
    held = licences.training_rows(templates, corpus, 20, 77)
    right = sum(model.predict(words)[0] == label for words, label in held)
    assert right / len(held) > 0.95
    docs = spark.createDataFrame(
        [(1, "Some prose here.\nReleased under the MIT License."), (2, "The general public went under the bridge to work."), (3, "License MIT the under released")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in licences.scan(docs, templates=templates, model=model).collect()}
    assert (got[1].families, got[1].spans, got[2].n_confirmed, got[3].n_confirmed) == ("mit", "1:mit", 0, 0)
    assert licences.scan(edge_docs, templates=templates, model=model).count() == edge_docs.count()
    assert licences.scan(no_docs, templates=templates).count() == 0


def test_wrapped_and_embedded_notices(spark):
    templates = licences.Templates()
    rng = random.Random(2)
    corpus = [[rng.choice("tions hean the of and work under version public general terms".split()) for _ in range(25)] for _ in range(300)]
    model = licences.fit(spark, licences.training_rows(templates, corpus, 40, 6), templates)
    for family in templates.families:
        for notice in licences.TEMPLATES[family]:
            for width in (30, 66):
                lines = textwrap.wrap(notice, width)
                text = "\n".join(["some code before it", " *", *(f" * {x}" for x in lines), " *", "and after it"])
                found = [(first + at, f) for first, ls in licences.paragraphs(text.encode()) for at, f in licences.judge(ls, templates, model, 0.6)[1]]
                assert any(f == family and 2 <= at < 2 + len(lines) for at, f in found), (family, width, found)
    mit = licences.TEMPLATES["mit"][1]
    long_line = " ".join(["hean tions"] * 400 + [mit] + ["tions hean"] * 400)
    block = "\n".join(["hean tions"] * 30 + textwrap.wrap(mit, 40) + ["tions hean"] * 30)
    docs = spark.createDataFrame([(1, long_line, "x"), (2, block, "x"), (3, "", "x"), (None, None, "x"), (1, long_line, "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_paragraphs, r.n_confirmed, r.spans) for r in licences.scan(docs, templates=templates, model=model).collect()}
    assert got == {1: (1, 1, "0:mit"), 2: (1, 1, "30:mit"), 3: (0, 0, ""), None: (0, 0, "")}
    with pytest.raises(ValueError):
        licences.Templates({"x": ["two words"]})


# urls

ENTRIES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("b.org", "", "allow"), ("c.org", "/p/q/r", "block"), ("c.org", "/p/", "allow"),
]
URLS = [
    "http://Www.Example.NET/en/1?x#y", "http://example.net/en", "http://example.net", "http://x.net?q=/a", "https://example.com/de/", "https://sub.example.com/de/a/b",
    "https://example.com/deu", "http://badexample.com/de/", "ftp://q.org/fr/", "http://a.org/xyz", "http://b.org", "http://c.org/p/q/rest", "http://c.org/p/qr",
    "no scheme", "", None, "a?u=http://c.org/p/", "http://net/", "http://ÄX.net/", "http://.net/", "http:///fr/", "http://a?b=http://x.net/c",
]


def brute_judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
    host = low(host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in ENTRIES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("most", [200_000, 0])
def test_urls_by_trie_and_by_join(spark, most):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], "x", "y")] * 2, "page_id long, url string, rule string, host string")
    entries = spark.createDataFrame(ENTRIES, "host string, path string, verdict string")
    got = url_trie.judge(pages, entries, most=most).collect()
    want = collections.Counter((r.page_id, *brute_judge(r.url)) for r in pages.collect())
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    none = entries.limit(0)
    assert {r.verdict for r in url_trie.judge(pages, none, default="block").collect()} == {"block"}
    assert url_trie.judge(pages.limit(0), entries, most=most).count() == 0
