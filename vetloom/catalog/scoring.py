"""Grading, notes and score roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vetloom.catalog.registry import SQL_VIEWS, query
from vetloom.catalog.sqltext import amount_ctes
from vetloom.operators import notes as N
from vetloom.operators import scoring as S

# The checker grades in its own terms: one CASE per item over the typed answers.
SQL_VIEWS["asked_v"] = """
    select a.attempt_id, a.definition_id, i.* exclude (definition_id) from attempts_v a join items_v i on a.definition_id = i.definition_id"""
SQL_VIEWS["given_v"] = """
    select q.*, r.* exclude (attempt_id, item_id) from asked_v q left join answers_v r on r.attempt_id = q.attempt_id and r.item_id = q.item_id"""
SQL_VIEWS["graded_v"] = rf"""
    with {amount_ctes('given_v', 'cell')}, judged as (select *, single is not null as answered,
      case item_id when 1 then single = 'N' when 2 then single = 'A'
        when 3 then multi_1 = 'N' and multi_2 = 'O' when 4 then coalesce(abs(amount - 25) <= 1 + 1e-9, false)
        when 5 then upper(typed) = 'NO' when 6 then regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') = 'GRN7'
        else line_1 in ('N', 'A') and line_2 = 'O' end as fits from am)
    select * exclude (fits, amount), case when answered then fits end as correct,
      case when not answered then 0 when item_id = 7 then cast(line_1 in ('N', 'A') as int) + cast(line_2 = 'O' as int)
        when fits then points else 0 end as awarded, coalesce(item_id in (1, 3) and single = 'R', false) as unsafe_hit from judged"""


def joined(t):
    return S.grade_join(t.attempts_v, t.items_v, t.responses_v)


def graded(t):
    return S.grade_items(joined(t), t.key_v)


@query("grade_join", """select q.attempt_id, q.item_id, type, r.single is not null as saved, r.code from asked_v q
    left join answers_v r on r.attempt_id = q.attempt_id and r.item_id = q.item_id""")
def _(t):
    return joined(t).select("attempt_id", "item_id", "type", F.col("single").isNotNull().alias("saved"), "code")


@query("grade_items", "select attempt_id, item_id, answered, correct, awarded, unsafe_hit from graded_v")
def _(t):
    return graded(t).select("attempt_id", "item_id", "answered", "correct", "awarded", "unsafe_hit")


@query(
    "match_best_key",
    """select attempt_id, item_id, greatest(base, alt) as points, case when alt > base then 1 else 0 end as variant from (select attempt_id, item_id,
      cast(line_1 = 'N' as int) + cast(line_2 = 'O' as int) as base, cast(line_1 = 'A' as int) + cast(line_2 = 'O' as int) as alt
      from answers_v where item_id = 7) x""",
)
def _(t):
    return S.match_best_key(t.responses_v, t.items_v, t.key_v)


_PCT = "floor(sum(awarded) / sum(points) * 1000 + 0.5) / 10"


@query("section_scores", f"select attempt_id, section, sum(awarded) as earned, sum(points) as max, {_PCT} as percent from graded_v group by 1, 2")
def _(t):
    return S.section_scores(graded(t))


@query("category_scores", f"select attempt_id, category, sum(awarded) as earned, sum(points) as max, {_PCT} as percent from graded_v group by 1, 2")
def _(t):
    return S.category_scores(graded(t))


@query("level_scores", "select attempt_id, level, sum(awarded) as earned, sum(points) as max from graded_v group by 1, 2")
def _(t):
    return S.level_scores(graded(t))


@query(
    "score_rollup",
    f"""select attempt_id, 'section' as kind, section as label, sum(awarded) as earned, sum(points) as max, {_PCT} as percent from graded_v group by 1, 2, 3
    union all select attempt_id, 'category', category, sum(awarded), sum(points), {_PCT} from graded_v group by 1, 2, 3
    union all select attempt_id, 'level', level, sum(awarded), sum(points), {_PCT} from graded_v group by 1, 2, 3
    union all select attempt_id, 'total', 'all', sum(awarded), sum(points), {_PCT} from graded_v group by 1, 2, 3""",
)
def _(t):
    return S.score_rollup(graded(t))


_OVERALL = """overall as (select attempt_id, sum(awarded) as overall_score, sum(points) as score_max,
      floor(40 * sum(case when category = 'knowledge' then awarded else 0 end) / sum(case when category = 'knowledge' then points else 0 end) + 0.5) as knowledge_score,
      floor(60 * sum(case when category = 'reconciliation' then awarded else 0 end) / sum(case when category = 'reconciliation' then points else 0 end) + 0.5) as reconciliation_score
    from graded_v group by 1)"""


@query("overall_score", f"with {_OVERALL} select *, knowledge_score + reconciliation_score as weighted from overall")
def _(t):
    return S.overall_score(graded(t), weighted=True)


@query("pass_flag", f"with {_OVERALL} select *, overall_score * 100.0 / score_max >= 75 as passed from overall")
def _(t):
    return S.pass_flag(S.overall_score(graded(t)))


@query(
    "combine_scores",
    f"""with {_OVERALL} select attempt_id, 'scored' as status, overall_score as total, score_max as total_max,
    floor(overall_score / score_max * 1000 + 0.5) / 10 as percent from overall""",
)
def _(t):
    return S.combine_scores(S.overall_score(graded(t))).select("attempt_id", "status", "total", "total_max", "percent")


@query(
    "critical_flags",
    """select attempt_id, case when bool_or(unsafe_hit) then 'Unsafe choice selected in a' else '' end as flags from graded_v group by 1""",
)
def _(t):
    return S.critical_flags(graded(t)).select("attempt_id", F.array_join("flags", "|").alias("flags"))


@query("items_correct", "select attempt_id, count(*) filter (coalesce(correct, false)) as items_correct, count(*) as items_total from graded_v group by 1")
def _(t):
    return S.items_correct(graded(t))


@query("answered_progress", "select attempt_id, count(*) filter (answered) as answered, count(*) as total from graded_v group by 1")
def _(t):
    return S.answered_progress(joined(t), t.key_v)


@query(
    "item_facility",
    """select item_id, level, round(sum(awarded) / sum(points), 6) as facility, case level when 'foundation' then round(sum(awarded) / sum(points), 6) between 0.75 and 0.95
      when 'core' then round(sum(awarded) / sum(points), 6) between 0.45 and 0.80 else round(sum(awarded) / sum(points), 6) between 0.30 and 0.65 end as in_band
    from graded_v group by 1, 2""",
)
def _(t):
    return S.item_facility(graded(t))


@query(
    "result_review",
    """select g.attempt_id, g.item_id, section || ': Question ' || g.item_id as prompt, coalesce(case g.type when 'single' then single when 'multi' then multi_1 || '; ' || multi_2
      when 'text' then typed when 'ref' then code when 'match' then 'l1: ' || line_1 || '; l2: ' || line_2 else cell end, 'Not answered') as chosen,
      case g.item_id when 1 then 'N' when 2 then 'A' when 3 then 'N; O' when 4 then '25' when 5 then 'no' when 6 then 'GRN-7' else 'l1: N; l2: O' end as expected, correct
    from graded_v g""",
)
def _(t):
    return S.result_review(joined(t), t.key_v)


@query(
    "candidate_view",
    f"""with {_OVERALL}, s as (select attempt_id, section, {_PCT} as p from graded_v group by 1, 2)
    select s.attempt_id, any_value(overall_score) as overall, string_agg(section || ' ' || cast(cast(p * 10 as bigint) as varchar) || ' ' ||
      case when p >= 75 then 'strong' when p >= 50 then 'reasonable' else 'practice' end, '; ' order by section) as sections
    from s join overall using (attempt_id) group by 1""",
)
def _(t):
    rows = graded(t)
    view = S.candidate_view(S.section_scores(rows), S.overall_score(rows))
    text = F.transform("sections", lambda s: F.concat_ws(" ", s["title"], F.round(s["percentage"] * 10).cast("bigint").cast("string"), s["band"]))
    return view.select("attempt_id", "overall", F.array_join(text, "; ").alias("sections"))


@query("attempts_used", "select definition_id, candidate_id, count(*) as used, count(*) >= 3 as at_limit from attempts_v group by 1, 2")
def _(t):
    return S.attempts_used(t.attempts_v, "definition_id", "candidate_id")


@query("version_count", "select p_brand, 'v' || cast(count(*) + 1 as varchar) as next_label from part group by 1")
def _(t):
    return S.version_count(t.part, "p_brand")


# ---- the earlier exercise format -----------------------------------------------------------

def exercises(t):
    """Stored exercise answers, one row per attempt, from its lines; of several lines for one question the last counts."""
    ref = F.concat(F.lit("T"), (F.col("l_partkey") % 8).cast("string"))
    choice = F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 5 == 0), "pay").otherwise(F.col("l_linestatus"))
    last = F.max_by("l_returnflag", "row_no").over(Window.partitionBy("l_orderkey", "l_linenumber"))
    rows = t.line_v.withColumn("chosen", last).groupBy(F.col("l_orderkey").alias("attempt_id")).agg(
        F.map_from_entries(F.collect_set(F.struct(F.col("l_linenumber").cast("string"), F.col("chosen")))).alias("mcq"),
        F.array_distinct(F.collect_list(ref)).alias("discrepancies"),
        F.array_distinct(F.array_sort(F.collect_list(F.struct(ref.alias("k"), choice.alias("v"))))).alias("pairs"),
    )
    keys = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    firsts = F.transform(keys, lambda k: F.struct(k.alias("k"), F.get(F.filter("pairs", lambda p: p["k"] == k), F.lit(0))["v"].alias("v")))
    stored = rows.join(t.orders.select(F.col("o_orderkey").alias("attempt_id"), "o_totalprice"), "attempt_id")
    balance = F.when(F.col("attempt_id") % 3 == 0, F.lit(100.0)).when(F.col("attempt_id") % 3 == 1, F.col("o_totalprice"))
    return stored.select("attempt_id", F.lit(1).alias("definition_id"), "mcq", "discrepancies", F.map_from_entries(firsts).alias("actions"), balance.alias("balance"))


def exercise_key(t):
    return t.spark.sql("""select 1 as definition_id, map('1','N','2','A','3','N','4','A','5','R') as key_mcq, array('T1','T2','T3') as key_discrepancies,
        map('T1','O','T2','F','T3','O') as key_actions, array('pay') as unsafe_actions, 100D as key_balance""")


@query(
    "score_exercise",
    """with a as (select l_orderkey as attempt_id, l_linenumber, l_returnflag, 'T' || cast(l_partkey % 8 as varchar) as ref,
        case when l_returnflag = 'R' and l_partkey % 5 = 0 then 'pay' else l_linestatus end as choice from line_v),
    l as (select l_orderkey as attempt_id, l_linenumber, arg_max(l_returnflag, row_no) as l_returnflag from line_v group by 1, 2),
    q as (select attempt_id, 8 * count(*) filter (l_returnflag = case l_linenumber when 1 then 'N' when 2 then 'A' when 3 then 'N' when 4 then 'A' when 5 then 'R' end) as knowledge_score from l group by 1),
    d as (select attempt_id, ref, min(choice) as choice from a group by 1, 2),
    r as (select attempt_id, count(*) filter (ref in ('T1', 'T2', 'T3')) as hits, count(*) filter (ref not in ('T1', 'T2', 'T3')) as false_positives,
      sum(case when ref = 'T1' and choice = 'O' then 7 when ref = 'T2' and choice = 'F' then 7 when ref = 'T3' and choice = 'O' then 6 else 0 end) as action_points,
      bool_or(choice = 'pay') as unsafe from d group by 1),
    s as (select r.*, knowledge_score, greatest(0, hits * 10 - false_positives * 8) as identification,
      case when attempt_id % 3 = 0 or (attempt_id % 3 = 1 and abs(o_totalprice - 100) < 0.005) then 10 else 0 end as balance_points
      from r join q using (attempt_id) join orders on o_orderkey = attempt_id)
    select attempt_id, knowledge_score, identification + action_points + balance_points as reconciliation_score,
      knowledge_score + identification + action_points + balance_points as overall_score, concat_ws('|', case when false_positives > 0 then 'false positive' end,
      case when identification + action_points + balance_points < 45 then 'reconciliation below threshold' end, case when unsafe then 'unsafe action' end) as flags,
      knowledge_score + identification + action_points + balance_points >= 80 and identification + action_points + balance_points >= 45 and not unsafe as strong from s""",
)
def _(t):
    scored = S.score_exercise(exercises(t), exercise_key(t))
    return scored.select("attempt_id", "knowledge_score", "reconciliation_score", "overall_score", F.array_join("flags", "|").alias("flags"), "strong")


# ---- notes ---------------------------------------------------------------------------------

CRITERIA = [
    (1, "c1", ["refund"], ["hold"], ["release"]),
    (1, "c2", [], ["tell finance", "today", "fine"], []),
    (1, "c3", ["doc-7"], [], ["household"]),
]


def notes(t):
    return t.notes_v.withColumn("item_id", F.lit(1))


def criteria(t):
    return t.spark.createDataFrame(
        CRITERIA, "item_id int, criterion_id string, all_of array<string>, any_of array<string>, none_of array<string>"
    )


def _list(values) -> str:
    return "cast([" + ", ".join(f"'{v}'" for v in values) + "] as varchar[])"


_CRIT = " union all ".join(f"select '{c}' as criterion_id, {_list(a)} as all_of, {_list(y)} as any_of, {_list(n)} as none_of" for _, c, a, y, n in CRITERIA)
_NEG = r"\b(not|never|no|none|without|don''t|doesn''t|didn''t|won''t|cannot|can''t|isn''t|aren''t|avoid|avoiding|stop|refuse|refused|decline|declined)\b"
_END = r"[,.;:!?()—–]|\b(?:but|however|so|then|unless|and)\b"
_AT = """list_filter(range(1, length(h) + 1), lambda i: substr(h, i, length(m)) = m and not regexp_matches(case when i > 1 then substr(h, i - 1, 1) else ' ' end, '[a-z0-9]')
    and not regexp_matches(coalesce(nullif(substr(h, i + length(m), 1), ''), ' '), '[a-z0-9]'))"""
_MARK = rf"""h as (select note_id, trim(regexp_replace(lower(note), '\s+', ' ', 'g')) as h from notes_v),
    crit as ({_CRIT}),
    terms as (select criterion_id, 'all' as part, unnest(all_of) as m, generate_subscripts(all_of, 1) as pos from crit
      union all select criterion_id, 'any', unnest(any_of), generate_subscripts(any_of, 1) from crit
      union all select criterion_id, 'none', unnest(none_of), generate_subscripts(none_of, 1) from crit),
    occ as (select note_id, criterion_id, part, m, pos, h, {_AT} as places from h, terms),
    hit as (select *, len(places) > 0 as present, len(list_filter(places, lambda i: not regexp_matches(regexp_replace(
      list_last(regexp_split_to_array(substr(h, greatest(1, i - 40), i - greatest(1, i - 40)), '{_END}')), '\bnot only\b', '', 'g'), '{_NEG}'))) > 0 as clean from occ),
    verdict as (select h.note_id, criterion_id, h.h = '' as blank, (select arg_min(m, pos) from hit x where x.note_id = h.note_id and x.criterion_id = crit.criterion_id and part = 'none' and clean) as blocked_by,
      (select bool_or(not present) from hit x where x.note_id = h.note_id and x.criterion_id = crit.criterion_id and part = 'all') as missing,
      (select string_agg(m, '|' order by pos) from hit x where x.note_id = h.note_id and x.criterion_id = crit.criterion_id and part = 'all' and not present) as absent,
      (select arg_min(m, pos) from hit x where x.note_id = h.note_id and x.criterion_id = crit.criterion_id and part = 'any' and clean) as choice,
      (select arg_min(m, pos) from hit x where x.note_id = h.note_id and x.criterion_id = crit.criterion_id and part = 'all' and present) as fact, len(any_of) as n_any
      from h, crit),
    scored as (select *, not blank and blocked_by is null and not coalesce(missing, false) and (n_any = 0 or choice is not null) as met from verdict)"""


@query("match_marker", f"with {_MARK} select note_id, criterion_id, fact from scored")
def _(t):
    joined_notes = notes(t).join(criteria(t), "item_id")
    return joined_notes.select("note_id", "criterion_id", N.match_marker(N.normalise_note(F.col("note")), F.col("all_of")).alias("fact"))


@query("match_unnegated", f"with {_MARK} select note_id, criterion_id, choice from scored")
def _(t):
    joined_notes = notes(t).join(criteria(t), "item_id")
    return joined_notes.select("note_id", "criterion_id", N.match_unnegated(N.normalise_note(F.col("note")), F.col("any_of")).alias("choice"))


@query(
    "score_criterion",
    f"""with {_MARK} select note_id, criterion_id, case when met then 2 else 0 end as points, case when met then coalesce(fact, choice) end as matched,
    blocked_by, coalesce(absent, '') as missing, blank from scored""",
)
def _(t):
    return N.score_criterion(notes(t), criteria(t)).drop("item_id").withColumn("missing", F.array_join("missing", "|"))


@query("score_note", f"with {_MARK} select note_id, sum(case when met then 2 else 0 end) as earned, 2 * count(*) as max, bool_or(blank) as blank from scored group by 1")
def _(t):
    return N.score_note(notes(t), criteria(t)).drop("item_id")
