"""Queries over reference spans, hypothesis spans and live emissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import metrics as m
from ..session import table
from ..sources import views
from ..sources.views import oracle
from .registry import register

KEY = ["meeting_id"]
_DER = """b as (select meeting_id, label, start_ms, end_ms, 0 as side from t_reference where end_ms > start_ms union all select meeting_id, label, start_ms, end_ms, 1 from t_spans where end_ms > start_ms),
e as (select distinct meeting_id, unnest([start_ms, end_ms]) as p from b), el as (select meeting_id, p, lead(p) over (partition by meeting_id order by p) as q from e),
c as (select el.meeting_id, p, q, label, max((side = 0)::int) as r, max((side = 1)::int) as h from el join b on b.meeting_id = el.meeting_id and b.start_ms <= p and b.end_ms >= q where q is not null group by all),
n as (select meeting_id, q - p as d, sum(r) as nr, sum(h) as nh, sum(r * h) as nc from c group by meeting_id, p, q),
der as (select meeting_id, sum(d * nr)::bigint as total, sum(d * greatest(0, nr - nh))::bigint as miss, sum(d * greatest(0, nh - nr))::bigint as false_alarm, sum(d * (least(nr, nh) - nc))::bigint as confusion from n group by meeting_id)"""
register("der_components", lambda spark, d: m.error_components(views.reference(spark, d), views.spans(spark, d), KEY), oracle("select * from der", "t_spans", "t_reference", ctes=_DER))
register("der_rate", lambda spark, d: m.error_components(views.reference(spark, d), views.spans(spark, d), KEY).agg(*[F.sum(c).alias(c) for c in ("total", "miss", "false_alarm", "confusion")]).withColumn("der", F.round((F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.nullif("total", F.lit(0)), 9)), oracle("select sum(total)::bigint as total, sum(miss)::bigint as miss, sum(false_alarm)::bigint as false_alarm, sum(confusion)::bigint as confusion, round((sum(miss) + sum(false_alarm) + sum(confusion)) / sum(total), 9) as der from der", "t_spans", "t_reference", ctes=_DER))


_LABELS = 5  # the five event types: the best of all 120 one-to-one mappings is the optimal one


def _map_sql(name: str, hyp: str) -> str:
    """Common table expressions for {name} (meeting_id, h_label, r_label): the optimal mapping of a table's labels."""
    pick = ", ".join(f"l{k}.label" for k in range(_LABELS))
    apart = " and ".join(f"l{a}.label <> l{b}.label" for a in range(_LABELS) for b in range(a))
    return f"""{name}_w as (select r.meeting_id, h.label as h_label, r.label as r_label, sum(least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)) as w from t_reference r join {hyp} h on h.meeting_id = r.meeting_id and h.start_ms < r.end_ms and r.start_ms < h.end_ms group by all),
{name}_l as (select label, row_number() over (order by label) as i from (select distinct label from t_reference)),
{name}_p as (select row_number() over () as p, [{pick}] as names from {", ".join(f"{name}_l l{k}" for k in range(_LABELS))} where {apart}),
{name}_c as (select p, unnest(names) as r_label, generate_subscripts(names, 1) as i from {name}_p),
{name}_b as (select meeting_id, max_by(p, s) as p from (select meeting_id, p, sum(w) as s from {name}_w w join {name}_c c using (r_label) join {name}_l l using (i) where l.label = w.h_label group by all) group by meeting_id),
{name} as (select meeting_id, l.label as h_label, c.r_label from {name}_b join {name}_c c using (p) join {name}_l l using (i) semi join {name}_w w on w.meeting_id = {name}_b.meeting_id and w.h_label = l.label and w.r_label = c.r_label)"""


def der_mapped(spark, d):
    ref, hyp = views.reference(spark, d), views.spans(spark, d)
    return m.error_components(ref, hyp, KEY, m.label_mapping(ref, hyp, KEY))


register("der_mapped", der_mapped, oracle("select * from der", "t_spans", "t_reference", ctes=_map_sql("mp", "t_spans") + ",\nhyp as (select s.* exclude (label), coalesce(mp.r_label, 'hyp ' || s.label) as label from t_spans s left join mp on mp.meeting_id = s.meeting_id and mp.h_label = s.label),\n" + _DER.replace("from t_spans", "from hyp")))
register("label_mapping", lambda spark, d: m.label_mapping(views.reference(spark, d), views.spans(spark, d), KEY), oracle("select * from mp", "t_spans", "t_reference", ctes=_map_sql("mp", "t_spans")))
_LAG = "lag as (select r.meeting_id, r.event_id, r.start_ms, case when c.e_end is not null then greatest(0, c.e_end - r.start_ms) end as lag_ms from t_reference r left join (select r.event_id, min_by(e.end_ms, e.idx) as e_end from t_reference r join t_emissions e on e.meeting_id = r.meeting_id and e.start_ms <= r.start_ms and r.start_ms < e.end_ms group by r.event_id) c using (event_id))"
_lag = lambda spark, d: m.emission_lag(views.reference(spark, d), views.emissions(spark, d), KEY, "event_id")
register("emission_lag", lambda spark, d: _lag(spark, d).select("meeting_id", "event_id", "lag_ms"), oracle("select meeting_id, event_id, lag_ms from lag", "t_emissions", "t_reference", ctes=_LAG))
register("lag_summary", lambda spark, d: _lag(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n_turns"), F.count("lag_ms").alias("n_covered"), F.round(F.median("lag_ms"), 6).alias("median_ms"), F.round(F.percentile("lag_ms", 0.9), 6).alias("p90_ms"), F.max("lag_ms").alias("max_ms")), oracle("select meeting_id, count(*) as n_turns, count(lag_ms) as n_covered, round(median(lag_ms), 6) as median_ms, round(quantile_cont(lag_ms, 0.9), 6) as p90_ms, max(lag_ms) as max_ms from lag group by meeting_id", "t_emissions", "t_reference", ctes=_LAG))
register("corpus_lag", lambda spark, d: _lag(spark, d).groupBy("meeting_id").agg(F.median("lag_ms").alias("med"), F.count("lag_ms").alias("n")).where("n > 0").agg(F.expr("round(percentile(med, 0.5, n), 6)").alias("median_ms"), F.expr("round(percentile(med, 0.9, n), 6)").alias("p90_ms"), F.sum("n").alias("n_covered")), oracle("select round(median(med), 6) as median_ms, round(quantile_cont(med, 0.9), 6) as p90_ms, count(*) as n_covered from (select med, unnest(range(n)) from (select median(lag_ms) as med, count(lag_ms) as n from lag group by meeting_id) where n > 0)", "t_emissions", "t_reference", ctes=_LAG))
register("flip_rate", lambda spark, d: m.flip_rate(views.emissions(spark, d), KEY).withColumn("flip_rate", F.round("flip_rate", 9)), oracle("select meeting_id, count(*) as n_pairs, count(*) filter (label <> n_label) as n_flips, round(count(*) filter (label <> n_label) / count(*), 9) as flip_rate from (select *, lead(label) over w as n_label, lead(start_ms) over w as n_start, lead(end_ms) over w as n_end from t_emissions where stable window w as (partition by meeting_id order by idx)) where n_label is not null and start_ms < n_end and n_start < end_ms group by meeting_id", "t_emissions"))


def runs_per_speaker(spark, d):
    runs = iv.label_runs(views.emissions(spark, d).where("stable"), KEY, ["idx"])
    s = views.emissions(spark, d).where("stable").groupBy("meeting_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    r = runs.groupBy("meeting_id").agg(F.count("*").alias("n_runs"), F.countDistinct("label").alias("n_speakers")).join(s, "meeting_id")
    return r.select("meeting_id", "n_runs", F.round(F.col("n_runs") / F.col("n_speakers"), 9).alias("runs_per_speaker"), F.round((F.col("n_runs") - 1) * 60000 / F.nullif("speech_ms", F.lit(0)), 9).alias("switches_per_minute"))


register("runs_per_speaker", runs_per_speaker, oracle("select meeting_id, count(*) filter (fresh) as n_runs, round(count(*) filter (fresh) / count(distinct label), 9) as runs_per_speaker, round((count(*) filter (fresh) - 1) * 60000 / sum(end_ms - start_ms), 9) as switches_per_minute from (select *, lag(label) over (partition by meeting_id order by idx) is distinct from label as fresh from t_emissions where stable) group by meeting_id", "t_emissions"))


def _timelines(spark, d):
    """What was shown live (stable emissions) and what stands at the end (all of them, clicks and errors under new names)."""
    e = views.emissions(spark, d)
    live = iv.last_writer_timeline(e.where("stable"), KEY, "idx")
    final = iv.last_writer_timeline(e.withColumn("label", F.when(F.col("label") == "click", "error").when(F.col("label") == "error", "click").otherwise(F.col("label"))), KEY, "idx")
    return live, final


def live_final_flip(spark, d):
    live, final = _timelines(spark, d)
    a = m.live_final_agreement(live, final, views.reference(spark, d), KEY)
    return a.withColumn("flip", F.round("flip", 9)).withColumn("uncovered", F.round("uncovered", 9))


def _timeline_sql(name: str, rows: str) -> str:
    """{name} (meeting_id, start_ms, end_ms, label): elementary pieces of the timeline in which a later index overwrites."""
    return f"""{name}_r as ({rows}),
{name}_e as (select distinct meeting_id, unnest([start_ms, end_ms]) as p from {name}_r where end_ms > start_ms), {name}_q as (select meeting_id, p, lead(p) over (partition by meeting_id order by p) as q from {name}_e),
{name} as (select e.meeting_id, p as start_ms, q as end_ms, max_by(label, idx) as label from {name}_q e join {name}_r r on r.meeting_id = e.meeting_id and r.start_ms <= p and r.end_ms >= q and r.end_ms > r.start_ms where q is not null group by all)"""


_AGREE = ",\n".join((_timeline_sql("live", "select * from t_emissions where stable"), _timeline_sql("fin", "select * exclude (label), case label when 'click' then 'error' when 'error' then 'click' else label end as label from t_emissions"), _map_sql("ml", "live"), _map_sql("mf", "fin"))) + """,
nl as (select l.* exclude (label), coalesce('ref ' || r_label, 'raw ' || label) as label from live l left join ml on ml.meeting_id = l.meeting_id and h_label = label),
nf as (select f.* exclude (label), coalesce('ref ' || r_label, 'raw ' || label) as label from fin f left join mf on mf.meeting_id = f.meeting_id and h_label = label),
j as (select f.meeting_id, sum(o) as judged_ms, coalesce(sum(o) filter (f.label <> l_label), 0) as flip_ms from (select f.meeting_id, f.label, l.label as l_label, least(f.end_ms, l.end_ms) - greatest(f.start_ms, l.start_ms) as o from nf f join nl l on l.meeting_id = f.meeting_id and l.start_ms < f.end_ms and f.start_ms < l.end_ms) f group by f.meeting_id),
t as (select meeting_id, sum(end_ms - start_ms) as total_ms from fin group by meeting_id)"""
register("live_final_flip", live_final_flip, oracle("select meeting_id, coalesce(flip_ms, 0)::bigint as flip_ms, coalesce(judged_ms, 0)::bigint as judged_ms, (total_ms - coalesce(judged_ms, 0))::bigint as uncovered_ms, round(flip_ms / nullif(judged_ms, 0), 9) as flip, round((total_ms - coalesce(judged_ms, 0)) / nullif(total_ms, 0), 9) as uncovered from t left join j using (meeting_id)", "t_emissions", "t_reference", ctes=_AGREE))
register("weighted_metric", lambda spark, d: views.spans(spark, d).groupBy("label").agg(F.round(m.weighted_mean(F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100), F.col("end_ms") - F.col("start_ms")), 6).alias("mean")), oracle("select label, round(sum(case when event_id % 4 <> 0 then event_id % 100 end * (end_ms - start_ms)) / nullif(sum(case when event_id % 4 <> 0 then end_ms - start_ms end), 0), 6) as mean from t_spans group by label", "t_spans"))
_METRIC = "mt as (select meeting_id, 'mean_minutes' as metric, avg(end_ms - start_ms) / 60000 as value from t_spans group by meeting_id union all select meeting_id, 'clicks', nullif(count(*) filter (label = 'click'), 0)::double from t_spans group by meeting_id)"


def _metric_rows(spark, d):
    s = views.spans(spark, d).groupBy("meeting_id").agg((F.avg(F.col("end_ms") - F.col("start_ms")) / 60000).alias("mean_minutes"), F.nullif(F.count_if(F.col("label") == "click"), F.lit(0)).cast("double").alias("clicks"))
    return s.unpivot("meeting_id", ["mean_minutes", "clicks"], "metric", "value")


def gate_failures(spark, d):
    bounds = spark.createDataFrame([("mean_minutes", 50.0), ("clicks", 20.0)], "metric string, bound double")
    return m.gate_failures(_metric_rows(spark, d), F.broadcast(bounds), KEY).withColumn("value", F.round("value", 6))


register("gate_failures", gate_failures, oracle("select meeting_id, metric, round(value, 6) as value, bound, case when value is null then 'no sample' else 'above bound' end as reason from mt join (values ('mean_minutes', 50.0::double), ('clicks', 20.0::double)) b(metric, bound) using (metric) where value is null or value > bound", "t_spans", ctes=_METRIC))


def report_rows(spark, d):
    rows = _metric_rows(spark, d).where("metric = 'mean_minutes'")
    base = rows.where("meeting_id % 3 <> 0").withColumn("value", F.col("value") * 0.5)
    return m.with_baseline(rows, base, ["meeting_id", "metric"], "value").select("meeting_id", (F.col("delta") == "n/a").alias("no_base"), F.round("base", 6).alias("base"))


register("report_rows", report_rows, oracle("select meeting_id, meeting_id % 3 = 0 as no_base, case when meeting_id % 3 <> 0 then round(value * 0.5, 6) end as base from mt where metric = 'mean_minutes'", "t_spans", ctes=_METRIC))


_GAPS, _LEASTS = (60_000, 300_000, 600_000, 1_200_000), (0, 1_800_000, 3_600_000)


def sweep_ranking(spark, d):
    """A grid of gap thresholds and least lengths; merged spans per setting, ranked on most meetings, the best two with
    their result on the held-out ones."""
    s = views.spans(spark, d).withColumn("gap_ms", F.explode(F.array(*map(F.lit, _GAPS))))
    runs = iv.merge_gaps(s, [*KEY, "gap_ms"], F.col("gap_ms"), ["start_ms", "event_id"]).withColumn("least_ms", F.explode(F.array(*map(F.lit, _LEASTS))))
    runs = runs.where("end_ms - start_ms >= least_ms").withColumn("held", F.col("meeting_id") % 4 == 0)
    mean = runs.groupBy("gap_ms", "least_ms").agg(F.avg(F.when(~F.col("held"), F.col("n_merged"))).alias("dev"), F.avg(F.when(F.col("held"), F.col("n_merged"))).alias("test"))
    return mean.orderBy(F.desc("dev"), "gap_ms", "least_ms").limit(2).select("gap_ms", "least_ms", F.round("dev", 6).alias("dev"), F.round("test", 6).alias("test"))


register("sweep_ranking", sweep_ranking, oracle(f"select gap_ms, least_ms, round(avg(n) filter (meeting_id % 4 <> 0), 6) as dev, round(avg(n) filter (meeting_id % 4 = 0), 6) as test from (select gap_ms, meeting_id, i, count(*) as n, max_by(end_ms, (start_ms, event_id)) - min(start_ms) as len from (select *, sum(f) over (partition by gap_ms, meeting_id order by start_ms, event_id) as i from (select *, case when lag(end_ms) over w is null or start_ms - lag(end_ms) over w >= gap_ms then 1 else 0 end as f from t_spans cross join (select unnest({list(_GAPS)})) g(gap_ms) window w as (partition by gap_ms, meeting_id order by start_ms, event_id))) group by all) join (select unnest({list(_LEASTS)})) l(least_ms) on len >= least_ms group by gap_ms, least_ms order by dev desc, gap_ms, least_ms limit 2", "t_spans"))
register("chunk_statistics", lambda spark, d: views.transcripts(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n"), F.count_if(F.col("dur_ms") < 1500).alias("n_short"), F.expr("element_at(array_sort(collect_list(dur_ms)), int(count(*) div 2) + 1)").alias("upper_median"), F.avg(F.when(F.col("dur_ms") > 60000, F.col("dur_ms"))).alias("mean_long")), oracle("select meeting_id, count(*) as n, count(*) filter (dur_ms < 1500) as n_short, list_sort(list(dur_ms))[count(*) // 2 + 1] as upper_median, avg(dur_ms) filter (dur_ms > 60000) as mean_long from t_transcripts group by meeting_id", "t_transcripts"))
register("batches_of_fifty", lambda spark, d: views.emissions(spark, d).withColumn("batch", F.expr("(idx - 1) div 50")).groupBy("meeting_id", "batch").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("sum_ms"), (F.max("start_ms") - F.min("start_ms")).alias("span_ms")).withColumn("per_hour", F.round(F.when(F.col("span_ms") > 0, F.col("n") * 3600000 / F.col("span_ms")).otherwise(0.0), 6)), oracle("select *, round(case when span_ms > 0 then n * 3600000 / span_ms else 0.0 end, 6) as per_hour from (select meeting_id, (idx - 1) // 50 as batch, count(*) as n, sum(end_ms - start_ms)::bigint as sum_ms, max(start_ms) - min(start_ms) as span_ms from t_emissions group by all)", "t_emissions"))
register("gap_warning", lambda spark, d: views.transcripts(spark, d).groupBy("meeting_id").agg(F.max("end_ms").alias("e"), F.sum(F.when(F.col("speaker") != "system", F.col("dur_ms")).otherwise(0)).alias("kept"), F.count_if(F.col("speaker") == "system").alias("failures")).select("meeting_id", F.when((F.col("e") - F.col("kept") > 30000) & ((F.col("e") - F.col("kept")) * 20 > F.col("e")), "gap").when(F.col("failures") > 0, "failures").otherwise("none").alias("warning")), oracle("select meeting_id, case when e - kept > 30000 and (e - kept) * 20 > e then 'gap' when failures > 0 then 'failures' else 'none' end as warning from (select meeting_id, max(end_ms) as e, sum(case when speaker <> 'system' then dur_ms else 0 end) as kept, count(*) filter (speaker = 'system') as failures from t_transcripts group by meeting_id)", "t_transcripts"))
register("latest_by_sequence", lambda spark, d: table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.min("event_id").alias("first_id")), "select user_id, event_type, max_by(event_id, (ts, event_id)) as latest, min(event_id) as first_id from events group by all")
