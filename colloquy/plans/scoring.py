"""Queries of transcript scoring: fragments aligned inside what was said, words in another script, lenient error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as al
from ..functions import text as x
from ..sources import views
from ..sources.views import oracle
from .registry import register

# What was heard of a turn: every fifth word in Cyrillic letters, words that begin with "of" not at all.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхижклмнопкрстуввкиз"


def _fragments(spark, d):
    """Each turn as a reference whose every seventh word is unheard, inside what was heard of it and its neighbours."""
    t = views.transcripts(spark, d)
    words = F.split(F.lower("text"), r"[^a-zà-ÿ0-9]+")
    said = t.select("meeting_id", "seq", F.filter(words, lambda w: w != "").alias("said"))
    ref = F.transform("said", lambda w, k: F.when(k % 7 == 6, F.lit(x.WILD)).otherwise(w))
    heard = F.transform("said", lambda w, k: F.when(k % 5 == 4, F.translate(w, _LATIN, _CYRILLIC)).otherwise(w))
    heard = said.select("meeting_id", "seq", F.filter(heard, lambda w: ~w.startswith("of")).alias("heard"))
    near = heard.select("meeting_id", F.explode(F.array(F.col("seq") - 1, F.col("seq"), F.col("seq") + 1)).alias("seq"), F.col("seq").alias("of"), "heard")
    hyp = near.groupBy("meeting_id", "seq").agg(F.array_sort(F.collect_list(F.struct("of", "heard"))).alias("h"))
    hyp = hyp.select("meeting_id", "seq", F.array_join(F.flatten(F.transform("h", lambda y: y["heard"])), " ").alias("hyp"))
    return said.select("meeting_id", "seq", F.array_join(ref, " ").alias("ref")).join(hyp, ["meeting_id", "seq"])


def _aligned(spark, d):
    return _fragments(spark, d).select("meeting_id", "seq", al.fragment_alignment("ref", "hyp").alias("e"))


def alignment_sql(free_ends: bool) -> str:
    """pr (f, pos, step, ref, hyp): the steps of aligning the word lists r and h of the rows f of ``fr``.

    The cost table row by row, the step into each cell, and the way back from the first cheapest end, or the corner.
    """
    unheard = f"case when r[%s] = '{x.WILD}' then 0 else 1 end as free"
    return f"""co as materialized (select f, 0::bigint as i, list_transform(range(len(h) + 1), lambda y: {"0::bigint" if free_ends else "y"}) as c from fr
  union all select f, i + 1, list_reduce(list_prepend([c[1] + free], list_transform(range(1, len(h) + 1), lambda j: [least(c[j] + case when h[j] = w then 0 else free end, c[j + 1] + free)])), lambda acc, y: list_append(acc, least(y[1], acc[-1] + 1)))
  from (select co.*, h, r[i + 1] as w, {unheard % "i + 1"} from co join fr using (f) where i < len(r))),
en as materialized (select f, len(r)::bigint as i, {"(list_position(c, list_min(c)) - 1)::bigint" if free_ends else "len(h)::bigint"} as j from fr join co using (f) where co.i = len(r)),
sc as materialized (select q.f, q.i, array_to_string(list_transform(range(1, len(h) + 2), lambda j: case when j > 1 and p.c[j - 1] + case when h[j - 1] = r[q.i] then 0 else free end = q.c[j] then 'S' when p.c[j] + free = q.c[j] then 'D' else 'I' end), '') as steps
  from (select co.*, r, h, {unheard % "i"} from co join fr using (f) where i > 0) q join co p on p.f = q.f and p.i = q.i - 1{"" if free_ends else " union all select f, 0, repeat('I', len(h) + 1) from fr"}),
back as (select f, i, j, null::varchar as step, 0 as k from en
  union all select b.f, case when sc.steps[b.j + 1] = 'I' then b.i else b.i - 1 end, case when sc.steps[b.j + 1] = 'D' then b.j else b.j - 1 end, sc.steps[b.j + 1], b.k + 1 from back b join sc on sc.f = b.f and sc.i = b.i where b.i > 0 or b.j > 0),
wd as (select f, k, step, case when step <> 'I' then r[i + 1] else '' end as ref, case when step <> 'D' then h[j + 1] else '' end as hyp from back join fr using (f) where step is not null),
pr as (select f, ref, case when step <> 'S' or (ref <> hyp and ref <> '{x.WILD}') then hyp end as hyp, step, max(k) over (partition by f) - k as pos from wd)"""


_FRAGMENTS = f"""sd as (select meeting_id, seq, list_filter(regexp_split_to_array(lower(text), '[^a-zà-ÿ0-9]+'), lambda w: w <> '') as said from t_transcripts),
hd as (select meeting_id, seq, list_filter(list_transform(said, lambda w, k: case when k % 5 = 0 then translate(w, '{_LATIN}', '{_CYRILLIC}') else w end), lambda w: not starts_with(w, 'of')) as heard from sd),
fr as (select row_number() over () as f, s.meeting_id, s.seq, list_transform(s.said, lambda w, k: case when k % 7 = 0 then '{x.WILD}' else w end) as r,
  flatten([coalesce((select heard from hd where hd.meeting_id = s.meeting_id and hd.seq = s.seq - 1), []), (select heard from hd where hd.meeting_id = s.meeting_id and hd.seq = s.seq), coalesce((select heard from hd where hd.meeting_id = s.meeting_id and hd.seq = s.seq + 1), [])]) as h from sd s),
{alignment_sql(True)},
ct as (select meeting_id, seq, count(*) filter (step = 'S' and hyp is not null) as substitutions, count(*) filter (step = 'D' and ref <> '{x.WILD}') as deletions, count(*) filter (step = 'I') as insertions, any_value(len(list_filter(r, lambda w: w <> '{x.WILD}'))) as n_ref from fr left join pr using (f) group by meeting_id, seq)"""


def _sql(select: str, ctes: str = _FRAGMENTS) -> str:
    return oracle(select, "t_transcripts", ctes=ctes).replace("with t_transcripts", "with recursive t_transcripts", 1)


_FIELDS = ("substitutions", "deletions", "insertions", "n_ref")
register("fragment_errors", lambda spark, d: _aligned(spark, d).select("meeting_id", "seq", *[f"e.{c}" for c in _FIELDS]), _sql("select meeting_id, seq, substitutions::int as substitutions, deletions::int as deletions, insertions::int as insertions, n_ref::int as n_ref from ct"))
register("fragment_pairs", lambda spark, d: _aligned(spark, d).select("meeting_id", "seq", F.posexplode("e.pairs").alias("pos", "p")).select("meeting_id", "seq", "pos", "p.ref", "p.hyp"), _sql("select meeting_id, seq, pos::int as pos, ref, hyp from pr join fr using (f)"))


def script_hits(spark, d):
    """Substitutions of a Latin word by letters of another script, how like its Cyrillic spelling they are, and whether it counts."""
    pairs = _aligned(spark, d).select(F.explode("e.pairs").alias("p")).select("p.ref", "p.hyp").where("ref <> '' and hyp <> '' and hyp is not null")
    kinds = pairs.groupBy("ref", "hyp").agg(F.count("*").alias("n"))
    spelt = al.said_in_cyrillic(F.col("ref"))
    return kinds.where(F.col("ref").rlike("^[a-z]+$") & ~F.col("hyp").rlike("^[a-z0-9]+$")).select("ref", "hyp", "n", spelt.alias("spelt"), F.round(al.likeness(spelt, "hyp"), 6).alias("likeness"), al.other_script(F.col("ref"), F.col("hyp")).alias("hit"))


_SPELT = "ref"
for _a, _b in al.SAID_AS:
    _SPELT = f"replace({_SPELT}, '{_a}', '{_b}')"
_SPELT = f"case when regexp_full_match(ref, '[a-z]+') and not regexp_full_match(hyp, '[a-z0-9]+') then {_SPELT} end"
# The common subsequence by its table, a letter of the one word a round.
_HITS = _FRAGMENTS + f""",
kd as (select ref, hyp, count(*) as n from pr where step = 'S' and hyp is not null group by ref, hyp), sp as (select *, {_SPELT} as spelt from kd),
lc as (select ref, hyp, spelt, 0::bigint as i, list_transform(range(length(hyp) + 1), lambda y: 0::bigint) as c from sp where spelt is not null
  union all select ref, hyp, spelt, i + 1, list_reduce(list_prepend([0::bigint], list_transform(range(1, length(hyp) + 1), lambda j: [case when substring(hyp, j, 1) = substring(spelt, i + 1, 1) then c[j] + 1 else c[j + 1] end])), lambda acc, y: list_append(acc, greatest(y[1], acc[-1]))) from lc where i < length(spelt)),
ht as (select sp.*, round(200.0 * c[-1] / (length(sp.spelt) + length(sp.hyp)), 6) as likeness, 200 * c[-1] >= 60 * (length(sp.spelt) + length(sp.hyp)) as hit from sp join lc on lc.ref = sp.ref and lc.hyp = sp.hyp and lc.i = length(lc.spelt))"""
register("script_hits", script_hits, _sql("select ref, hyp, n, spelt, likeness, hit from ht", _HITS))


def lenient_rates(spark, d):
    """Word error rates of each recording, and the same where a word in the other script counts as correct."""
    e = _aligned(spark, d)
    rate = e.groupBy("meeting_id").agg(*[F.sum(f"e.{c}").alias(c) for c in _FIELDS])
    words = e.select("meeting_id", F.explode("e.pairs").alias("p")).select("meeting_id", "p.ref", "p.hyp").where(al.in_other_letters(F.col("ref"), F.col("hyp")))
    kinds = words.groupBy("meeting_id", "ref", "hyp").agg(F.count("*").alias("n"))  # so that words are compared once a recording
    hits = kinds.where(al.other_script(F.col("ref"), F.col("hyp"))).groupBy("meeting_id").agg(F.sum("n").alias("hits"))
    wrong = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    share = lambda n: F.round(n * 100.0 / F.nullif("n_ref", F.lit(0)), 6)
    return rate.join(hits, "meeting_id", "left").select("meeting_id", *_FIELDS, share(wrong).alias("wer"), share(wrong - F.coalesce("hits", F.lit(0))).alias("lenient"))


register("lenient_rates", lenient_rates, _sql("select meeting_id, s::bigint as substitutions, d::bigint as deletions, i::bigint as insertions, n::bigint as n_ref, round((s + d + i) * 100.0 / nullif(n, 0), 6) as wer, round((s + d + i - coalesce(hits, 0)) * 100.0 / nullif(n, 0), 6) as lenient from (select meeting_id, sum(substitutions) as s, sum(deletions) as d, sum(insertions) as i, sum(n_ref) as n from ct group by meeting_id) left join (select meeting_id, count(*) as hits from pr join fr using (f) join ht on ht.ref = pr.ref and ht.hyp = pr.hyp where step = 'S' and hit group by meeting_id) using (meeting_id)", _HITS))
