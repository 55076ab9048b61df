"""The registered queries of the operators, with production parameters over whole tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vetloom.llm import (
    bpe, decontaminate, exact_dedup, lexical_search, licences, line_dedup, prefix_trie, quality, secret_scan, sharding, simhash, url_trie, warc,
)
from vetloom.sources.tables import read_table

#: Entries of the url filter.
URL_ENTRIES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Shards of the corpus by name and weight, now and after one more is added.
SHARDS = {f"shard-{i:02d}": 1 for i in range(16)}
NEXT_SHARDS = {f"shard-{i:02d}": 1 for i in range(17)}
SLOTS = 4099


def op1_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(read_table(spark, sf_dir, "pages"))


def op3_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(list(URL_ENTRIES), "host string, path string, verdict string")
    return url_trie.judge(read_table(spark, sf_dir, "pages"), entries)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(read_table(spark, sf_dir, "documents"))


def op6_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op7_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(read_table(spark, sf_dir, "documents"))


def op9_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.plan_growth(read_table(spark, sf_dir, "documents"), "doc_id", SHARDS, NEXT_SHARDS, SLOTS)
    return placed.withColumnRenamed("key", "doc_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_guess_cost, op2_warc_transactions, op3_url_trie, op4_byte_bpe, op5_quality_cascade, op6_licence_classifier,
        op7_simhash_gray_index, op8_line_dedup, op9_shard_table, op10_decontaminate, op11_bloom_search,
        op12_digest_index, op13_prefix_trie,
    )
}

WARC_SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
h as (select *, max(page_id) over (partition by d) as top from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(8), lambda i: list_transform([('0x' || substr(d, 5 * i + 1, 5))::int],
    lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::int + 1, 1)), ''))[1]), '')
    as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to,
  u.url as target_uri, 'GET /' || regexp_extract(u.url, '://[^/]*/([^#]*)', 1) || ' HTTP/1.1' as request_line
from h join pages u using (page_id)
"""

URL_SQL = """
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
r(rhost, rpath, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select page_id, arg_max(r, length(rhost) + length(rpath)) as best from u join r
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select page_id, host, path, best.rhost || best.rpath as rule, coalesce(best.verdict, 'allow') as verdict from u left join m using (page_id)
"""

QUALITY_SQL = r"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, unnest(range(1, len(ws) - 6)) as i, ws from w),
twice as (select doc_id, array_to_string(ws[i : i + 7], ' ') as x, list(i) as spots from win group by 1, 2 having count(*) > 1),
hit as (select doc_id, unnest(spots) as i from twice),
rep as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 8)) as k from hit) group by 1),
l as (select doc_id, unnest(string_split(t, chr(10))) as line from w),
d as (select doc_id, count(*) - count(distinct line) as n, count(*) as lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
c as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(d.n, 0) as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, coalesce(d.lines, 0) as lines
  from w left join d using (doc_id) left join rep using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 10 * n_symbols <= 3 * n_words and 2 * n_dup_lines <= lines and word_chars between 2 * n_words and 20 * n_words as kept
from b
"""

LINES_SQL = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
e as (select *, length(line) as n from l where trim(line) <> ''),
d as (select line, n, min((doc_id, line_no)) as place from e group by 1, 2),
k as (select line, n, place, unnest([(m, 'first', left(line, m // 2)), (m, 'last', right(line, m - m // 2))]) as half
  from (select *, unnest([n, n - 1]) as m from d where n >= 20)),
pairs as (select distinct a.line, b.line as other from k a join k b on a.half = b.half and a.line <> b.line and b.place < a.place and abs(a.n - b.n) <= 1),
near as (select distinct line from pairs where len(list_filter(range(0, greatest(length(line), length(other))), lambda i: left(line, i) = left(other, i) and (
    (length(line) = length(other) and substr(line, i + 2) = substr(other, i + 2)) or (length(line) + 1 = length(other) and substr(line, i + 1) = substr(other, i + 2))
    or (length(line) = length(other) + 1 and substr(line, i + 2) = substr(other, i + 1))))) > 0),
gone as (select e.doc_id, e.line_no from e join d using (line) where (e.doc_id, e.line_no) <> d.place or line in (select line from near))
select t.doc_id, coalesce(cast(len(string_split(text, chr(10))) as bigint), 0) as n_lines, cast(count(g.line_no) as bigint) as n_removed,
  coalesce(string_agg(cast(g.line_no as varchar), ',' order by g.line_no), '') as removed
from documents t left join gone g on t.doc_id = g.doc_id group by t.doc_id, text
"""


def _fill_sql(name: str, shards: int) -> str:
    """CTEs that fill a table of ``SLOTS`` slots turn by turn: ``{name}(slot, shard)``."""
    number = "('0x' || substr(md5(s || '/{}'), 1, 15))::bigint"
    return f"""
{name}_p as (select list(list_transform(range({SLOTS}), lambda j: (o + j * k) % {SLOTS}) order by s) as prefs from (
  select s, {number.format("offset")} % {SLOTS} as o, {number.format("step")} % {SLOTS - 1} + 1 as k
  from (select 'shard-' || lpad(cast(i as varchar), 2, '0') as s from range({shards}) r(i)))),
{name}_f as (
  select 0 as turn, list_transform(range({SLOTS}), lambda x: -1) as filled from {name}_p
  union all
  select turn + 1, list_transform(filled, lambda x, i: case when i - 1 = pick then turn % {shards} else x end) from (
    select turn, filled, list_filter(prefs[turn % {shards} + 1], lambda x: filled[x + 1] = -1)[1] as pick from {name}_f, {name}_p where turn < {SLOTS})),
{name} as (select unnest(range({SLOTS})) as slot, unnest(list_transform(filled, lambda x: 'shard-' || lpad(cast(x as varchar), 2, '0'))) as shard
  from {name}_f where turn = {SLOTS})"""


SHARD_SQL = f"""
with recursive {_fill_sql("now", len(SHARDS))}, {_fill_sql("later", len(NEXT_SHARDS))},
d as (select doc_id, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {SLOTS} as slot from documents)
select d.doc_id, d.slot, now.shard, later.shard as next_shard from d join now using (slot) join later using (slot)
"""

BENCHMARK_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select item_id, n, array_to_string(ws[i : i + n - 1], ' ') as x
  from (select item_id, ws, least(13, len(ws)) as n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as x from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, sizes)),
m as (select distinct doc_id, i, n, item_id from dw join bw using (n, x)),
hit as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + n)) as k from m) group by 1),
items as (select doc_id, list(distinct cast(item_id as varchar)) as ids from m group by 1),
runs as (select doc_id, item_id, pos, i, n from (select distinct dw.doc_id, dw.i, dw.n, bp.item_id, bp.pos from dw join (
    select item_id, n, i as pos, array_to_string(ws[i : i + n - 1], ' ') as x from (select item_id, ws, least(13, len(ws)) as n,
      unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)) bp using (n, x))),
long as (select doc_id, max(c + n - 1) as longest from (select doc_id, item_id, i - pos as shift, n, g, count(*) as c from (
    select *, i - row_number() over (partition by doc_id, item_id, i - pos order by i) as g from runs) group by all) group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(list_sort(ids), ','), '')) as items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(ws) as contaminated,
  cast(coalesce(longest, 0) as bigint) as longest_match
from w left join hit using (doc_id) left join items using (doc_id) left join long using (doc_id)
"""

SEARCH_SQL = r"""
with d as (select doc_id, row_number() over () as r, text as t from documents),
dw as (select doc_id, r, unnest(regexp_extract_all(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
tf as (select doc_id, r, term, cast(count(*) as bigint) as tf from dw group by all),
len as (select r, cast(sum(tf) as bigint) as n from tf group by 1),
tot as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_all from len),
i as (select item_id, row_number() over () as q, text as t from benchmark),
iw as (select distinct item_id, q, unnest(regexp_extract_all(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from i),
df as (select term, count(*) as df from tf where term in (select term from iw) group by 1),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1))) as bigint) as w from df, tot),
s as (select item_id, q, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_all)))) as bigint) as score
  from iw join w using (term) join tf using (term) join len using (r), tot group by all),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50
"""

DIGEST_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
r as (select *, row_number() over (partition by t order by doc_id nulls last) as place from n)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, place = 1 as kept, sha256(t) as text_sha256 from r
"""

TRIE_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
own as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, md5(length(role) || ':' || role || text)) as turns from t group by 1),
crc as (select *, coalesce(xor(list_reduce([ord(x) for x in string_split(conv_id::varchar, '')], lambda c, b: list_reduce(range(8), lambda v, k:
    case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(c, b)), 4294967295), 4294967295) % 4, 0) as h from own),
whole as (select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
  from crc c left join own b on b.conv_id = c.conv_id - c.conv_id % 20),
steps as (select conv_id, turns, unnest(range(len(turns) + 1)) as d from whole),
node as (select turns[1:d] as path, d, min(conv_id) as conv_id, count(*) as n, list(conv_id order by conv_id) filter (where len(turns) = d and conv_id is not null) as ends
  from steps group by 1, 2),
kids as (select path[1:d - 1] as path, count(*) as n from node where d > 0 group by 1),
each as (select n.path, n.d, n.n, kids.path is null as leaf,
  case when d > 0 then (n.n - 1) * len(regexp_extract_all(n.path[d].text, '[^\x20\x09-\x0D]+')) else 0 end as saved from node n left join kids using (path)),
below as (select path[1:u] as path, sum(leaf::int) as leaves, sum(saved) as saved from (select *, unnest(range(d + 1)) as u from each) group by 1)
select n.conv_id, cast(n.d as bigint) as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(kids.n, 0) as n_children, cast(b.leaves as bigint) as n_leaves,
  cast(b.saved as bigint) as saved_tokens, sha256(coalesce(array_to_string(n.ends, ','), '')) as ends_sha256
from node n join below b using (path) left join kids using (path) left join node p on n.d > 0 and p.path = n.path[1:n.d - 1]
"""

#: Queries without an entry have no SQL form: guess costs, byte-level merges, a trained model, XXH64.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_transactions": WARC_SQL,
    "op3_url_trie": URL_SQL,
    "op5_quality_cascade": QUALITY_SQL,
    "op8_line_dedup": LINES_SQL,
    "op9_shard_table": SHARD_SQL,
    "op10_decontaminate": BENCHMARK_SQL,
    "op11_bloom_search": SEARCH_SQL,
    "op12_digest_index": DIGEST_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
