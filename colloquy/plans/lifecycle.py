"""Queries that change voiceprints, cluster caches, runs and tags: the next state of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import changes, relational, runs
from ..operators import intervals as iv
from ..operators import vectors as v
from ..session import table
from ..sources import views
from ..sources.views import oracle
from .registry import register


def run_states(spark, d):
    """Summary runs: a failed one gets its backup back, an interrupted one fails, a finished one keeps its result."""
    m = views.meetings(spark, d).select("meeting_id", "status", F.when(F.col("meeting_id") % 3 == 0, F.col("title")).alias("backup"), F.when(F.col("meeting_id") % 2 == 0, F.col("status")).alias("result"))
    state = F.when(F.col("status") == "P", "failed").when(F.col("status") == "O", "restored").otherwise("done")
    result = F.when(F.col("status") == "O", F.coalesce("backup", "result")).otherwise(F.col("result"))
    return m.select("meeting_id", state.alias("state"), result.alias("result"), F.when(F.col("status") != "O", F.col("backup")).alias("backup"))


register("run_states", run_states, oracle("select meeting_id, case status when 'P' then 'failed' when 'O' then 'restored' else 'done' end as state, case when status = 'O' then coalesce(b, r) else r end as result, case when status <> 'O' then b end as backup from (select meeting_id, status, case when meeting_id % 3 = 0 then title end as b, case when meeting_id % 2 = 0 then status end as r from t_meetings)", "t_meetings"))


def enroll(spark, d):
    """The coherent longest rows of each meeting and channel go to one speaker; every speaker keeps its best 25."""
    p = views.prototypes(spark, d)
    picked = v.coherent_pick(p.withColumn("pool", F.col("meeting_id") * 2 + (F.col("channel") == "mic").cast("int")), "pool", "id", "embedding", "duration", 16, 4, -1.0)
    moved = picked.select("id", (F.col("pool") % 7).cast("int").alias("speaker_id"))
    now = changes.patch(p.select("id", "speaker_id", "duration"), moved, ["id"], "speaker_id")
    return relational.keep_best(now, ["speaker_id"], [F.desc("duration"), "id"], 25)


register("enroll", enroll, oracle("select id, speaker_id, duration from (select id, duration, coalesce(case when rn <= 4 then ((meeting_id * 2 + case when channel = 'mic' then 1 else 0 end) % 7)::int end, speaker_id) as speaker_id from (select *, row_number() over (partition by meeting_id, channel order by duration desc, id) as rn from t_prototypes)) qualify row_number() over (partition by speaker_id order by duration desc, id) <= 25", "t_prototypes"))


def cluster_cache(spark, d):
    """New cache rows replace the unassigned ones of their meeting and channel; assigned rows stay."""
    p = views.prototypes(spark, d).select("id", "meeting_id", "channel", F.when(F.col("is_verified"), F.col("speaker_id")).alias("speaker_id"))
    new = p.where("meeting_id < 5 and id % 4 = 0").select((F.col("id") + 1_000_000).alias("id"), "meeting_id", "channel", F.lit(None).cast("int").alias("speaker_id"))
    loose = p.where("speaker_id is null").join(new.select("meeting_id", "channel").distinct(), ["meeting_id", "channel"], "left_anti")
    return p.where("speaker_id is not null").unionByName(loose.select(*p.columns)).unionByName(new)


register("cluster_cache", cluster_cache, oracle("select * from p where speaker_id is not null or (meeting_id, channel) not in (select meeting_id, channel from n) union all select * from n", "t_prototypes", ctes="p as (select id, meeting_id, channel, case when is_verified then speaker_id end as speaker_id from t_prototypes), n as (select id + 1000000 as id, meeting_id, channel, null::int as speaker_id from p where meeting_id < 5 and id % 4 = 0)"))


def demote_foreign(spark, d):
    """Rows whose label no reference span of their meeting supports lose their owner, unless a user verified them."""
    rows = views.spans(spark, d).select("meeting_id", "event_id", "label", "start_ms", "end_ms")
    own = views.reference(spark, d).select("meeting_id", "label", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    foreign = iv.without_overlap(rows, own, ["meeting_id", "label"]).select("event_id", F.lit(True).alias("foreign"))
    return rows.join(foreign, "event_id", "left").select("event_id", F.when(F.col("foreign") & (F.col("event_id") % 3 != 0), F.lit(None)).otherwise(F.col("label")).alias("owner"))


register("demote_foreign", demote_foreign, oracle("select event_id, case when event_id % 3 <> 0 and not exists (select 1 from t_reference o where o.meeting_id = s.meeting_id and o.label = s.label and o.start_ms < s.end_ms and s.start_ms < o.end_ms) then null else label end as owner from t_spans s", "t_spans", "t_reference"))
register("purge_voiceprints", lambda spark, d: views.prototypes(spark, d).where("is_verified or duration >= 2").select("id", "speaker_id", F.when(F.col("duration") < 5, F.lit(None)).otherwise(F.col("duration")).alias("clip")), oracle("select id, speaker_id, case when duration < 5 then null else duration end as clip from t_prototypes where is_verified or duration >= 2", "t_prototypes"))


def tag_create(spark, d):
    """Names that exist in any case come back as they are; the others get an id behind the last one and a palette colour.

    Asked for are the tags' own names in lower case and the market segments; ids follow the names' order.
    """
    t = views.tags(spark, d).select(F.col("tag_id").cast("long").alias("tag_id"), "name", x.palette_key(F.col("name")).alias("palette"))
    asked = t.select(F.lower("name").alias("name")).unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"))).unionByName(table(spark, d, "customer").select(F.lower("c_mktsegment").alias("name")))
    asked = asked.groupBy(F.lower("name").alias("key")).agg(F.max("name").alias("name"))
    fresh = asked.join(t.select(F.lower("name").alias("key")), "key", "left_anti")
    return changes.insert_ignore(t, changes.numbered(fresh, "key").select((F.col("number") + t.agg(F.max("tag_id")).scalar()).alias("tag_id"), "name", x.palette_key(F.col("name")).alias("palette")), ["name"])


_PALETTE_SQL = f"({list(x.PALETTE)})[list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(lower(trim(name)), ''), lambda c: ascii(c)::bigint)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 40 + 1]"
_FRESH_SQL = "f as (select lower(c_mktsegment) as key, max(n) as name from (select c_mktsegment, unnest([c_mktsegment, lower(c_mktsegment)]) as n from customer) group by 1 having lower(c_mktsegment) not in (select lower(name) from t_tags)), made as (select tag_id::bigint as tag_id, name from t_tags union all select (select max(tag_id) from t_tags) + row_number() over (order by key), name from f)"
register("tag_create", tag_create, oracle(f"select tag_id, name, {_PALETTE_SQL} as palette from made", "t_tags", ctes=_FRESH_SQL))
register("unused_tags", lambda spark, d: tag_create(spark, d).join(views.tag_links(spark, d), "tag_id", "left_anti").select("tag_id", "name"), oracle("select tag_id, name from made where tag_id not in (select tag_id from t_tag_links)", "t_tags", "t_tag_links", ctes=_FRESH_SQL))
register("channel_gauge", lambda spark, d: views.spans(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("e"), F.min("start_ms").alias("s")).select("meeting_id", F.least(F.lit(1.0), F.round(F.col("n") / 120, 6)).alias("filled"), F.round(1 - F.least(F.lit(1.0), F.col("n") / 120), 6).alias("rest"), (F.col("e") - F.col("s") > 2_505_600_350).alias("stuck")), oracle("select meeting_id, least(1.0, round(n / 120, 6)) as filled, round(1 - least(1.0, n / 120), 6) as rest, e - s > 2505600350 as stuck from (select meeting_id, count(*) as n, max(end_ms) as e, min(start_ms) as s from t_spans group by meeting_id)", "t_spans"))
register("all_refined", lambda spark, d: views.spans(spark, d).groupBy("meeting_id", F.expr("start_ms div 86400000").alias("day")).agg(F.collect_list(F.col("event_id") % 7 != 0).alias("refined")).select("meeting_id", "day", (F.forall("refined", lambda r: r) & (F.size("refined") > 0)).alias("all_refined")), oracle("select meeting_id, start_ms // 86400000 as day, bool_and(event_id % 7 <> 0) as all_refined from t_spans group by all", "t_spans"))


def _started(spark, d):
    """Runs of all meetings; those with an open order start again, and with them some meetings that had none."""
    m = views.meetings(spark, d)
    old = m.where("meeting_id % 4 <> 1").select("meeting_id", F.when(F.col("status") == "P", "failed").otherwise("completed").alias("status"), F.lit(1).alias("start_time"), F.when(F.col("meeting_id") % 3 != 0, F.col("title")).alias("result"), F.lit(None).cast("string").alias("backup"), F.when(F.col("status") == "P", "old").alias("error"))
    return m, runs.start(old, m.where("status <> 'F'").select("meeting_id", F.lit(2).alias("start_time")), "meeting_id")


def run_outcomes(spark, d):
    """Ends of the started runs: some complete, fail or are cancelled, some ends are of an earlier start; the rest was interrupted."""
    m, state = _started(spark, d)
    k = F.col("meeting_id") % 5
    ends = m.where("meeting_id % 5 < 4").select("meeting_id", F.when(k == 3, 1).otherwise(2).alias("start_time"), F.when(k == 0, "completed").when(k == 1, "failed").when(k == 2, "cancelled").otherwise("completed").alias("outcome"), F.concat(F.lit("new "), "title").alias("result"), F.when(k != 0, F.lit("why")).alias("error"))
    return runs.fail_interrupted(runs.finish(state, ends, "meeting_id"), "meeting_id", "interrupted")


_RUNS = """o as (select meeting_id, case status when 'P' then 'failed' else 'completed' end as status, case when meeting_id % 3 <> 0 then title end as result, case when status = 'P' then 'old' end as error from t_meetings where meeting_id % 4 <> 1),
s as (select m.meeting_id, m.title, m.status <> 'F' as started, o.status, o.result, o.error, m.meeting_id % 5 as k from t_meetings m left join o using (meeting_id) where m.status <> 'F' or o.meeting_id is not null)"""
register("run_outcomes", run_outcomes, oracle("select meeting_id, case when not started then status when k = 0 then 'completed' when k = 2 then 'cancelled' else 'failed' end as status, case when started then 2 else 1 end as start_time, case when started and k = 0 then 'new ' || title else result end as result, null::varchar as backup, case when not started then error when k = 0 then null when k in (1, 2) then 'why' else 'interrupted' end as error from s", "t_meetings", ctes=_RUNS))
