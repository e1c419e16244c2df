"""Queries over labelled spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..sources import views
from ..sources.views import oracle
from .registry import register

KEY = ["meeting_id"]


def _right(df, *more):
    return df.select("meeting_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("label").alias("r_label"), F.col("event_id").alias("r_id"), *more)


def _left(spark, d):
    return views.spans(spark, d).where("label <> 'view'").select("meeting_id", "event_id", "label", "start_ms", "end_ms")


def _turns(spark, d):
    return _right(views.spans(spark, d).where("label = 'view' or label = 'click'"))


_LR = "l as (select * from t_spans where label <> 'view'), r as (select meeting_id, start_ms as r_start, end_ms as r_end, label as r_label, event_id as r_id from t_spans where label in ('view', 'click'))"
_PAIRS = ", p as (select l.*, r.* exclude (meeting_id), least(end_ms, r_end) - greatest(start_ms, r_start) as overlap_ms from l join r on l.meeting_id = r.meeting_id and start_ms < r_end and r_start < end_ms)"

register("overlap_pairs", lambda spark, d: iv.overlap_join(_left(spark, d), _turns(spark, d), KEY).groupBy("meeting_id").agg(F.count("*").alias("n_pairs"), F.sum("overlap_ms").alias("overlap_ms")), oracle("select meeting_id, count(*) as n_pairs, sum(overlap_ms)::bigint as overlap_ms from p group by meeting_id", "t_spans", ctes=_LR + _PAIRS))
register("max_overlap", lambda spark, d: iv.max_overlap(_left(spark, d), _turns(spark, d), KEY, ["event_id"], ["r_start", "r_id"]).select("meeting_id", "event_id", "r_label", "r_id", "overlap_ms"), oracle("select meeting_id, event_id, r_label, r_id, overlap_ms from p qualify row_number() over (partition by event_id order by overlap_ms desc, r_start, r_id) = 1", "t_spans", ctes=_LR + _PAIRS))
register(
    "nearest_fallback",
    lambda spark, d: iv.attribute(_left(spark, d), _turns(spark, d), KEY, ["event_id"], ["r_start", "r_id"], "r_label", 600_000).select("meeting_id", "event_id", "assigned", "how"),
    oracle(
        "select l.meeting_id, l.event_id, coalesce(h.r_label, o.only_label, g.r_label) as assigned, case when h.r_label is not null then 'overlap' when o.only_label is not null then 'only' when g.r_label is not null then 'nearest' end as how from l left join h using (event_id) left join o on o.meeting_id = l.meeting_id left join g using (event_id)",
        "t_spans",
        ctes=_LR
        + """, q as (select * from r),
p as (select l.meeting_id, event_id, r_label, r_start, r_id, least(end_ms, r_end) - greatest(start_ms, r_start) as ov, greatest(start_ms - r_end, r_start - end_ms, 0) as gap from l join q on l.meeting_id = q.meeting_id),
h as (select event_id, r_label from p where ov > 0 qualify row_number() over (partition by event_id order by ov desc, r_start, r_id) = 1),
o as (select meeting_id, min(r_label) as only_label from q group by meeting_id having min(r_label) = max(r_label)),
g as (select event_id, r_label from p where gap <= 600000 and event_id not in (select event_id from h) qualify row_number() over (partition by event_id order by gap, r_start, r_id) = 1)""",
    ),
)
register("overlap_vote", lambda spark, d: iv.overlap_vote(_left(spark, d), _turns(spark, d), KEY, ["event_id"], "r_label").select("meeting_id", "event_id", "r_label", "overlap_ms"), oracle("select meeting_id, event_id, r_label, s::bigint as overlap_ms from (select meeting_id, event_id, r_label, sum(overlap_ms) as s from p group by all) qualify row_number() over (partition by event_id order by s desc, r_label) = 1", "t_spans", ctes=_LR + _PAIRS))
register("demote_candidates", lambda spark, d: iv.without_overlap(_left(spark, d), _turns(spark, d).where("r_label = 'view'").select("meeting_id", "r_start", "r_end"), KEY).select("meeting_id", "event_id"), oracle("select meeting_id, event_id from l where not exists (select 1 from r where r_label = 'view' and r.meeting_id = l.meeting_id and r_start < l.end_ms and l.start_ms < r_end)", "t_spans", ctes=_LR))
register("gap_merge", lambda spark, d: iv.merge_gaps(views.spans(spark, d), KEY, 600_000, ["start_ms", "event_id"]).select("meeting_id", "start_ms", "end_ms", "n_merged"), oracle("select meeting_id, min(start_ms) as start_ms, max_by(end_ms, (start_ms, event_id)) as end_ms, count(*) as n_merged from (select *, sum(f) over (partition by meeting_id order by start_ms, event_id) as i from (select *, case when lag(end_ms) over w is null or start_ms - lag(end_ms) over w >= 600000 then 1 else 0 end as f from t_spans window w as (partition by meeting_id order by start_ms, event_id))) group by meeting_id, i", "t_spans"))
register("gap_merge_max", lambda spark, d: iv.merge_gaps(views.spans(spark, d), KEY, 600_000, ["start_ms", "event_id"], "max").select("meeting_id", "start_ms", "end_ms", "n_merged"), oracle("select meeting_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_merged from (select *, sum(f) over (partition by meeting_id order by start_ms, event_id) as i from (select *, case when max(end_ms) over w is null or start_ms - max(end_ms) over w >= 600000 then 1 else 0 end as f from t_spans window w as (partition by meeting_id order by start_ms, event_id rows between unbounded preceding and 1 preceding))) group by meeting_id, i", "t_spans"))
register(
    "same_label_bridge",
    lambda spark, d: iv.bridge_same_label(views.spans(spark, d), KEY, 300_000, ["start_ms", "event_id"]).select("meeting_id", "label", "start_ms", "end_ms", "n_merged"),
    oracle(
        "select meeting_id, label, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_merged from (select *, sum(f) over (partition by meeting_id, run order by start_ms, event_id) as i from b) group by meeting_id, label, run, i",
        "t_spans",
        ctes="""a as (select *, sum(t) over (partition by meeting_id order by start_ms, event_id) as run from (select *, case when lag(label) over (partition by meeting_id order by start_ms, event_id) is not distinct from label then 0 else 1 end as t from t_spans)),
b as (select *, case when max(end_ms) over w is null or start_ms - max(end_ms) over w > 300000 then 1 else 0 end as f from a window w as (partition by meeting_id, run order by start_ms, event_id rows between unbounded preceding and 1 preceding))""",
    ),
)
_RUNS = "runs as (select meeting_id, label, run, min(start_ms) as start_ms, max_by(end_ms, (start_ms, event_id)) as end_ms, count(*) as n_rows from (select *, sum(t) over (partition by meeting_id order by start_ms, event_id)::bigint as run from (select *, case when lag(label) over (partition by meeting_id order by start_ms, event_id) is not distinct from label then 0 else 1 end as t from t_spans)) group by meeting_id, label, run)"
register("label_runs", lambda spark, d: iv.label_runs(views.spans(spark, d), KEY, ["start_ms", "event_id"]), oracle("select * from runs", "t_spans", ctes=_RUNS))
register("lead_run_valid", lambda spark, d: (lambda r: r.withColumn("next_rows", F.lead("n_rows").over(Window.partitionBy("meeting_id").orderBy("run"))).select("meeting_id", "run", (F.coalesce("next_rows", F.lit(0)) >= 2).alias("next_holds")))(iv.label_runs(views.spans(spark, d), KEY, ["start_ms", "event_id"])), oracle("select meeting_id, run, coalesce(lead(n_rows) over (partition by meeting_id order by run), 0) >= 2 as next_holds from runs", "t_spans", ctes=_RUNS))
register("asof_anchor", lambda spark, d: iv.as_of(_left(spark, d), views.spans(spark, d).where("label = 'view'").groupBy("meeting_id", "start_ms").agg(F.max("end_ms").alias("anchor_end")), KEY, "start_ms", "anchor_end").select("meeting_id", "event_id", F.when(F.col("anchor_end").isNotNull(), F.greatest(F.col("anchor_end") - F.col("start_ms"), F.lit(0))).alias("shift_ms")), oracle("select l.meeting_id, l.event_id, case when a.e is not null then greatest(a.e - l.start_ms, 0) end as shift_ms from l asof left join (select meeting_id, start_ms, max(end_ms) as e from t_spans where label = 'view' group by all) a on l.meeting_id = a.meeting_id and l.start_ms >= a.start_ms", "t_spans", ctes=_LR))
_PIECES = "e as (select distinct meeting_id, unnest([start_ms, end_ms]) as p from s), el as (select meeting_id, p as p_start, lead(p) over (partition by meeting_id order by p) as p_end from e)"
_LWW = (
    "s as (select * from t_emissions where stable and end_ms > start_ms), "
    + _PIECES
    + """, top as (select el.meeting_id, p_start, p_end, max_by(label, idx) as label from el join s on s.meeting_id = el.meeting_id and s.start_ms <= p_start and s.end_ms >= p_end where p_end is not null group by all),
lww as (select meeting_id, label, min(p_start) as start_ms, max(p_end) as end_ms from (select *, sum(t) over (partition by meeting_id order by p_start) as run from (select *, case when lag(label) over w is not distinct from label and lag(p_end) over w = p_start then 0 else 1 end as t from top window w as (partition by meeting_id order by p_start))) group by meeting_id, label, run)"""
)
register("lww_timeline", lambda spark, d: iv.last_writer_timeline(views.emissions(spark, d).where("stable"), KEY, "idx").select("meeting_id", "label", "start_ms", "end_ms"), oracle("select * from lww", "t_emissions", ctes=_LWW))
register("dense_windows", lambda spark, d: iv.dense_windows(views.spans(spark, d), 3_600_000, 1_800_000).select("meeting_id", "event_id", F.col("w_index").alias("k"), "w_start", "w_end"), oracle("select meeting_id, event_id, k, start_ms + k * 1800000 as w_start, least(start_ms + k * 1800000 + 3600000, end_ms) as w_end from (select *, unnest(range(0, case when end_ms - start_ms > 3600000 then ceil((end_ms - start_ms - 3600000) / 1800000)::bigint else 0 end + 1)) as k from t_spans)", "t_spans"))
register("overlapping_chunks", lambda spark, d: iv.dense_windows(views.spans(spark, d), 600_000, 595_000).groupBy("meeting_id").agg(F.count("*").alias("n_chunks"), F.sum(F.col("w_end") - F.col("w_start")).alias("chunk_ms")), oracle("select meeting_id, count(*) as n_chunks, sum(least(start_ms + k * 595000 + 600000, end_ms) - start_ms - k * 595000)::bigint as chunk_ms from (select *, unnest(range(0, case when end_ms - start_ms > 600000 then ceil((end_ms - start_ms - 600000) / 595000)::bigint else 0 end + 1)) as k from t_spans) group by meeting_id", "t_spans"))
register(
    "span_subtract",
    lambda spark, d: iv.subtract(_left(spark, d), _turns(spark, d).where("r_label = 'view'").select("meeting_id", "r_start", "r_end"), KEY, ["event_id"]),
    oracle(
        "select meeting_id, event_id, p_start, p_end from (select meeting_id, event_id, unnest(list_concat([start_ms], coalesce(list(r_end order by r_start), []))) as p_start, unnest(list_concat(coalesce(list(r_start order by r_start), []), [end_ms])) as p_end from (select l.*, u.r_start, u.r_end from l join u on u.meeting_id = l.meeting_id and u.r_start < l.end_ms and l.start_ms < u.r_end) group by meeting_id, event_id, start_ms, end_ms union all select meeting_id, event_id, start_ms, end_ms from l where not exists (select 1 from u where u.meeting_id = l.meeting_id and u.r_start < l.end_ms and l.start_ms < u.r_end)) where p_end > p_start",
        "t_spans",
        ctes=_LR
        + ", u as (select meeting_id, min(r_start) as r_start, max(r_end) as r_end from (select *, sum(f) over (partition by meeting_id order by r_start, r_end) as i from (select *, case when max(r_end) over w is null or r_start - max(r_end) over w >= 1 then 1 else 0 end as f from r where r_label = 'view' and r_end > r_start window w as (partition by meeting_id order by r_start, r_end rows between unbounded preceding and 1 preceding))) group by meeting_id, i)",
    ),
)
register("support_union", lambda spark, d: iv.union_spans(views.spans(spark, d), KEY), oracle("select meeting_id, min(start_ms) as start_ms, max(end_ms) as end_ms from (select *, sum(f) over (partition by meeting_id order by start_ms, end_ms) as i from (select *, case when max(end_ms) over w is null or start_ms - max(end_ms) over w >= 1 then 1 else 0 end as f from t_spans where end_ms > start_ms window w as (partition by meeting_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding))) group by meeting_id, i", "t_spans"))


def window_override(spark, d):
    over = views.spans(spark, d).where("label = 'purchase'").select("meeting_id", F.col("event_id").alias("o_id"), "start_ms", "end_ms")
    rows = _right(views.spans(spark, d).where("label in ('view', 'click')"))
    best = iv.max_overlap(over, rows, KEY, ["o_id"], ["r_start", "r_id"])
    return best.groupBy("meeting_id", "r_id").agg(F.max("o_id").alias("override_id"))


register("window_override", window_override, oracle("select meeting_id, r_id, max(o_id) as override_id from (select o.meeting_id, o.event_id as o_id, r_id from t_spans o join r on r.meeting_id = o.meeting_id and o.start_ms < r_end and r_start < o.end_ms where o.label = 'purchase' qualify row_number() over (partition by o.event_id order by least(end_ms, r_end) - greatest(start_ms, r_start) desc, r_start, r_id) = 1) group by all", "t_spans", ctes=_LR))
register("window_label_all", lambda spark, d: iv.overlap_join(_left(spark, d), _turns(spark, d).where("r_label = 'view'"), KEY).groupBy("meeting_id", "event_id").agg(F.max("r_id").alias("view_id")), oracle("select meeting_id, event_id, max(r_id) as view_id from p where r_label = 'view' group by all", "t_spans", ctes=_LR + _PAIRS))


def carry_identity(spark, d):
    bound = views.spans(spark, d).where("event_id % 3 = 0")
    new = views.reference(spark, d).select("meeting_id", "event_id", "start_ms", "end_ms")
    best = iv.max_overlap(new, _right(bound), KEY, ["event_id"], ["r_start", "r_id"])
    return new.join(best.select("meeting_id", "event_id", "r_id"), ["meeting_id", "event_id"], "left").select("meeting_id", "event_id", F.col("r_id").alias("carried_from"))


register("carry_identity", carry_identity, oracle("select n.meeting_id, n.event_id, b.c as carried_from from t_reference n left join (select r.event_id, s.event_id as c from t_reference r join t_spans s on s.meeting_id = r.meeting_id and s.event_id % 3 = 0 and s.start_ms < r.end_ms and r.start_ms < s.end_ms qualify row_number() over (partition by r.event_id order by least(r.end_ms, s.end_ms) - greatest(r.start_ms, s.start_ms) desc, s.start_ms, s.event_id) = 1) b using (event_id)", "t_spans", "t_reference"))
register("protected_windows", lambda spark, d: iv.without_overlap(views.transcripts(spark, d).select("meeting_id", "seq", "start_ms", "end_ms"), views.transcripts(spark, d).where("speaker = 'system'").select("meeting_id", (F.col("start_ms") - 1).alias("r_start"), (F.col("end_ms") + 1).alias("r_end")), KEY).select("meeting_id", "seq"), oracle("select meeting_id, seq from t_transcripts t where not exists (select 1 from t_transcripts s where s.speaker = 'system' and s.meeting_id = t.meeting_id and s.start_ms - 1 < t.end_ms and t.start_ms < s.end_ms + 1)", "t_transcripts"))


def midpoint_join(spark, d):
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    points = _left(spark, d).select("meeting_id", "event_id", mid.alias("start_ms"), (mid + 1).alias("end_ms"))
    return iv.overlap_join(points, _turns(spark, d), KEY).groupBy("meeting_id", "event_id").agg(F.min("r_id").alias("first_id"), F.count("*").alias("n"))


register("midpoint_join", midpoint_join, oracle("select l.meeting_id, event_id, min(r_id) as first_id, count(*) as n from l join r on r.meeting_id = l.meeting_id and r_start <= (start_ms + end_ms) // 2 and (start_ms + end_ms) // 2 < r_end group by all", "t_spans", ctes=_LR))
register("window_text", lambda spark, d: (lambda t: iv.overlap_join(t.where("seq = 1").select("meeting_id", "start_ms", (F.col("end_ms") + 20000).alias("end_ms")), t.select("meeting_id", "seq", "text", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")), KEY).groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text")).select("meeting_id", F.sha2("text", 256).alias("text_sha256")))(views.transcripts(spark, d)), oracle("select a.meeting_id, sha256(string_agg(b.text, ' ' order by b.seq)) as text_sha256 from t_transcripts a join t_transcripts b on a.meeting_id = b.meeting_id and a.seq = 1 and b.start_ms < a.end_ms + 20000 and a.start_ms < b.end_ms group by a.meeting_id", "t_transcripts"))
