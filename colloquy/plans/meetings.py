"""Queries over meetings, turns, tags and voiceprint rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes, relational
from ..session import table
from ..sources import views
from ..sources.views import oracle
from .registry import register


# -- names and projections ---------------------------------------------------------------------------------------------


def _named(spark, d):
    """Turns with four sources of a name: override, own match, cluster binding, legacy label."""
    t = views.transcripts(spark, d)
    s = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("sid"), F.col("n_name").alias("sname"))
    t = t.withColumn("override_id", F.when((F.col("meeting_id") + F.col("seq")) % 7 == 0, (F.col("meeting_id") + F.col("seq")) % 25)).withColumn("auto_id", F.when((F.col("meeting_id") * 3 + F.col("seq")) % 4 == 0, (F.col("meeting_id") * 3 + F.col("seq")) % 30))
    cluster = table(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("speaker")).distinct()
    cluster = cluster.where("speaker <> 'system'").withColumn("cluster_id", F.col("meeting_id") % 25).withColumn("user_bound", F.col("meeting_id") % 3 == 0)
    name = lambda k: s.select(F.col("sid").alias(f"{k}_id"), F.col("sname").alias(f"{k}_name"))
    return t.join(cluster, ["meeting_id", "speaker"], "left").join(name("override"), "override_id", "left").join(name("auto"), "auto_id", "left").join(name("cluster"), "cluster_id", "left")


_NAMED = """
named as (
  select t.*, o.n_name as override_name, a.n_name as auto_name, c.n_name as cluster_name, user_bound
  from (select *, case when (meeting_id + seq) % 7 = 0 then (meeting_id + seq) % 25 end as override_id,
               case when (meeting_id * 3 + seq) % 4 = 0 then (meeting_id * 3 + seq) % 30 end as auto_id from t_transcripts) t
  left join (select distinct conv_id as meeting_id, role as speaker, conv_id % 25 as cluster_id, conv_id % 3 = 0 as user_bound from conversations where role <> 'system') k using (meeting_id, speaker)
  left join nation o on o.n_nationkey = override_id left join nation a on a.n_nationkey = auto_id left join nation c on c.n_nationkey = cluster_id
)"""


def display_name(spark, d):
    name, source = relational.display_name(F.col("override_name"), F.col("user_bound"), F.col("auto_name"), F.col("cluster_name"), F.col("speaker"))
    return _named(spark, d).select("meeting_id", "seq", name.alias("name"), source.alias("provenance"))


register(
    "display_name",
    display_name,
    oracle(
        """select meeting_id, seq, coalesce(override_name, case when not coalesce(user_bound, false) then auto_name end, cluster_name, speaker) as name,
  case when override_name is not null then 'override' when not coalesce(user_bound, false) and auto_name is not null then 'row'
       when cluster_name is not null and coalesce(user_bound, false) then 'user' when cluster_name is not null then 'cluster' when speaker is not null then 'legacy' end as provenance
from named""",
        "t_transcripts",
        ctes=_NAMED,
    ),
)
register("simple_name", lambda spark, d: _named(spark, d).select("meeting_id", "seq", F.coalesce("override_name", "cluster_name", "speaker").alias("name")), oracle("select meeting_id, seq, coalesce(override_name, cluster_name, speaker) as name from named", "t_transcripts", ctes=_NAMED))


def parent_fallback(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("there"))
    lines = table(spark, d, "lineitem")
    title = F.coalesce(F.when(F.col("there").isNotNull(), F.concat(F.lit("Meeting "), F.col("l_orderkey").cast("string"))), F.when(F.col("l_orderkey").isNotNull(), F.lit("deleted meeting")))
    return lines.join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", title.alias("title"), F.col("l_shipdate").isNotNull().alias("has_clip"))


register("parent_fallback", parent_fallback, "select l_orderkey, l_linenumber, coalesce(case when o_orderkey is not null then 'Meeting ' || l_orderkey end, case when l_orderkey is not null then 'deleted meeting' end) as title, l_shipdate is not null as has_clip from lineitem left join (select o_orderkey from orders where o_orderstatus <> 'P') on o_orderkey = l_orderkey")


# -- lists, pages, counts ----------------------------------------------------------------------------------------------

register("meeting_list", lambda spark, d: views.meetings(spark, d).orderBy(F.desc("created_at"), "meeting_id").select("meeting_id", "title", "created_at"), oracle("select meeting_id, title, created_at from t_meetings order by created_at desc, meeting_id", "t_meetings"))
register("meeting_by_id", lambda spark, d: views.transcripts(spark, d).where("meeting_id = 7").select("meeting_id", "seq", "speaker", "start_ms", "end_ms"), oracle("select meeting_id, seq, speaker, start_ms, end_ms from t_transcripts where meeting_id = 7", "t_transcripts"))
register("transcript_page", lambda spark, d: relational.page(views.transcripts(spark, d).select("meeting_id", "seq", "start_ms"), ["start_ms", "meeting_id", "seq"], 20, 25), oracle("select *, count(*) over () as total, 20 + 25 < count(*) over () as has_more from (select meeting_id, seq, start_ms from t_transcripts) order by start_ms, meeting_id, seq limit 25 offset 20", "t_transcripts"))
register("tag_usage", lambda spark, d: relational.usage(views.tags(spark, d), views.tag_links(spark, d), "tag_id"), oracle("select tag_id, name, palette, count(meeting_id) as n_links from t_tags left join t_tag_links using (tag_id) group by all", "t_tags", "t_tag_links"))


def tags_by_meeting(spark, d):
    j = views.tag_links(spark, d).join(F.broadcast(views.tags(spark, d)), "tag_id")
    return relational.sorted_list(j, "meeting_id", "name", "name", "tag_names")


register("tags_by_meeting", tags_by_meeting, oracle("select meeting_id, string_agg(name, ',' order by name) as tag_names from t_tag_links join t_tags using (tag_id) group by meeting_id", "t_tags", "t_tag_links"))


def storage_stats(spark, d):
    p = views.prototypes(spark, d)
    size = F.size("embedding") * 4
    own = F.col("id") % 5 != 0
    return p.agg(F.count("*").alias("n_rows"), F.sum(size).cast("long").alias("total_bytes"), F.count_if(own).alias("n_prototypes"), F.count_if(~own).alias("n_caches"), F.coalesce(F.sum(F.when(own, size)), F.lit(0)).cast("long").alias("prototype_bytes"), F.countDistinct("speaker_id").alias("n_speakers"))


register("storage_stats", storage_stats, oracle("select count(*) as n_rows, sum(len(embedding) * 4)::bigint as total_bytes, count(*) filter (id % 5 <> 0) as n_prototypes, count(*) filter (id % 5 = 0) as n_caches, coalesce(sum(len(embedding) * 4) filter (id % 5 <> 0), 0)::bigint as prototype_bytes, count(distinct speaker_id) as n_speakers from t_prototypes", "t_prototypes"))
register("clip_totals", lambda spark, d: views.prototypes(spark, d).agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("is_verified"), 1)).alias("n_clips"), F.sum(F.when(F.col("is_verified"), F.size("embedding"))).cast("long").alias("clip_size")), oracle("select count(*) as n_rows, count(case when is_verified then 1 end) as n_clips, sum(case when is_verified then len(embedding) end)::bigint as clip_size from t_prototypes", "t_prototypes"))
register("pairs_preview", lambda spark, d: views.prototypes(spark, d).where("duration > 5").groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("n")).groupBy("speaker_id").agg(F.sum("n").alias("n_rows"), F.countDistinct("meeting_id").alias("n_meetings")), oracle("select speaker_id, count(*) as n_rows, count(distinct meeting_id) as n_meetings from t_prototypes where duration > 5 group by speaker_id", "t_prototypes"))


def voiceprint_lists(spark, d):
    p = views.prototypes(spark, d)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return p.groupBy("speaker_id").agg(ids.alias("ids"), F.count_if(~F.col("is_verified")).alias("n_unverified"), F.count_if(F.col("duration") < 1.5).alias("n_suspect"))


register("voiceprint_lists", voiceprint_lists, oracle("select speaker_id, string_agg(id::varchar, ',' order by id) as ids, count(*) filter (not is_verified) as n_unverified, count(*) filter (duration < 1.5) as n_suspect from t_prototypes group by speaker_id", "t_prototypes"))
register("suspect_speakers", lambda spark, d: views.prototypes(spark, d).groupBy("speaker_id").agg(F.bool_or((F.col("duration") < 1.0) & ~F.col("is_verified")).alias("any_suspect")), oracle("select speaker_id, bool_or(duration < 1.0 and not is_verified) as any_suspect from t_prototypes group by speaker_id", "t_prototypes"))
register("import_check", lambda spark, d: views.transcripts(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("last_end")), oracle("select meeting_id, count(*) as n, max(end_ms) as last_end from t_transcripts group by meeting_id", "t_transcripts"))
register("distinct_labels", lambda spark, d: views.spans(spark, d).groupBy("meeting_id").agg(F.countDistinct("label").alias("n_labels")), oracle("select meeting_id, count(distinct label) as n_labels from t_spans group by meeting_id", "t_spans"))


def meeting_stats(spark, d):
    t = views.transcripts(spark, d)
    words = F.regexp_count("text", F.lit(views.WORD))
    g = t.groupBy("meeting_id").agg(F.sum(words).cast("long").alias("n_words"), F.max_by("end_ms", "seq").alias("duration_ms"))
    return g.withColumn("wpm", F.round(F.col("n_words") * 60000 / F.col("duration_ms"), 6))


register("meeting_stats", meeting_stats, oracle("select *, round(n_words * 60000 / duration_ms, 6) as wpm from (select meeting_id, sum(len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0B]+')))::bigint as n_words, max_by(end_ms, seq) as duration_ms from t_transcripts group by meeting_id)", "t_transcripts"))


def daily_counts(spark, d):
    e = table(spark, d, "events")
    by_day = e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))
    return by_day.withColumn("days_since_first", F.datediff(F.col("day").cast("date"), F.lit("2024-01-01").cast("date")))


register("daily_counts", daily_counts, "select ts::date::varchar as day, count(*) as n_events, count(distinct user_id) as n_users, (ts::date - date '2024-01-01')::int as days_since_first from events group by ts::date")

# -- joins and predicates ----------------------------------------------------------------------------------------------

register("search_case_insensitive", lambda spark, d: views.tags(spark, d).where(F.lower("name") == F.lower(F.lit("NaTioN_7"))), oracle("select * from t_tags where lower(name) = lower('NaTioN_7')", "t_tags"))
register("pair_filter", lambda spark, d: views.spans(spark, d).join(spark.createDataFrame([(1, "click"), (2, "view"), (3, "purchase")], "meeting_id long, label string"), ["meeting_id", "label"], "left_semi"), oracle("select * from t_spans where (meeting_id, label) in (values (1, 'click'), (2, 'view'), (3, 'purchase'))", "t_spans"))
register("status_in_list", lambda spark, d: views.meetings(spark, d).where(F.col("status").isin("F", "P")).groupBy("status").agg(F.count("*").alias("n")), oracle("select status, count(*) as n from t_meetings where status in ('F', 'P') group by status", "t_meetings"))
register("bound_left_join", lambda spark, d: (lambda t, k: t.join(k.where("user_bound"), "meeting_id", "left").select("meeting_id", "seq", "bound_to"))(views.transcripts(spark, d), table(spark, d, "conversations").groupBy(F.col("conv_id").alias("meeting_id")).agg((F.max("turn") % 2 == 0).alias("user_bound"), F.min("role").alias("bound_to"))), oracle("select t.meeting_id, t.seq, k.bound_to from t_transcripts t left join (select conv_id, max(turn) % 2 = 0 as user_bound, min(role) as bound_to from conversations group by conv_id) k on k.conv_id = t.meeting_id and user_bound", "t_transcripts"))
register("existence_guard", lambda spark, d: table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_totalprice > 1000").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n")), "select l_returnflag, count(*) as n from lineitem join orders on o_orderkey = l_orderkey where o_totalprice > 1000 group by l_returnflag")


def meeting_search(spark, d):
    hits = views.spans(spark, d).where("label = 'purchase' and end_ms - start_ms > 6000000")
    names = views.tag_links(spark, d).join(F.broadcast(views.tags(spark, d)), "tag_id").groupBy("meeting_id").agg(F.collect_list("name").alias("names"))
    return relational.match_or_name(views.meetings(spark, d), hits, names, "an").select("meeting_id", "title")


register("meeting_search", meeting_search, oracle("select meeting_id, title from t_meetings where meeting_id in (select meeting_id from t_spans where label = 'purchase' and end_ms - start_ms > 6000000) or contains(lower(title), 'an') or meeting_id in (select meeting_id from t_tag_links join t_tags using (tag_id) where contains(lower(name), 'an'))", "t_meetings", "t_spans", "t_tags", "t_tag_links"))


def recovery_window(spark, d):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_update"))
    return last.where((F.col("last_update") > now - F.expr("interval 7 days")) & (F.col("last_update") < now - F.expr("interval 2 seconds"))).select("user_id", F.expr("unix_micros(cast(last_update as timestamp))").alias("last_us"))


register("recovery_window", recovery_window, "select user_id, epoch_us(max(ts)) as last_us from events group by user_id having max(ts) > timestamp '2024-01-30' - interval 7 day and max(ts) < timestamp '2024-01-30' - interval 2 second")
register("non_blank", lambda spark, d: views.transcripts(spark, d).where(F.trim("text") != "").groupBy("speaker").agg(F.count("*").alias("n")), oracle("select speaker, count(*) as n from t_transcripts where trim(text) <> '' group by speaker", "t_transcripts"))


def drop_sensitive(spark, d):
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("device_name"), F.col("event_type")))
    kept = text.without_sensitive(props)
    return table(spark, d, "events").select("event_id", F.size(kept).alias("n_kept"), F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"))


register("drop_sensitive", drop_sensitive, f"select event_id, len(k)::int as n_kept, array_to_string(list_sort(k), ',') as keys from (select event_id, list_filter(list_append(json_keys(props), 'device_name'), lambda x: x not in {text.SENSITIVE_KEYS}) as k from events)")

# -- windows, top lists, sets ------------------------------------------------------------------------------------------


def dedupe_voiceprints(spark, d):
    p = views.prototypes(spark, d).withColumn("block", F.floor(F.col("duration") / 5)).withColumn("clip", F.when(F.col("id") % 4 == 3, F.col("id")))
    return relational.dedupe_with_donor(p, ["speaker_id", "meeting_id", "channel", "block"], [F.desc("is_verified"), F.desc("duration"), "id"], "clip").select("speaker_id", "meeting_id", "channel", "block", "id", "clip")


register(
    "dedupe_voiceprints",
    dedupe_voiceprints,
    oracle(
        """select speaker_id, meeting_id, channel, block, id, clip from (
  select *, row_number() over w as rn, coalesce(c, first_value(c ignore nulls) over (w rows between unbounded preceding and unbounded following)) as clip from p
  window w as (partition by speaker_id, meeting_id, channel, block order by is_verified desc, duration desc, id)) where rn = 1""",
        "t_prototypes",
        ctes="p as (select *, floor(duration / 5)::bigint as block, case when id % 4 = 3 then id end as c from t_prototypes)",
    ),
)
register("prototype_cap", lambda spark, d: relational.keep_best(views.prototypes(spark, d), ["speaker_id"], [F.desc("duration"), "id"], 30).select("speaker_id", "id", "duration"), oracle("select speaker_id, id, duration from t_prototypes qualify row_number() over (partition by speaker_id order by duration desc, id) <= 30", "t_prototypes"))
register("topk_exemplars", lambda spark, d: relational.keep_best(views.prototypes(spark, d), ["meeting_id", "channel"], [F.desc("duration"), "id"], 8).select("meeting_id", "channel", "id"), oracle("select meeting_id, channel, id from t_prototypes qualify row_number() over (partition by meeting_id, channel order by duration desc, id) <= 8", "t_prototypes"))
register("append_page", lambda spark, d: (lambda t: relational.first_seen(t.where("seq <= 4").unionByName(t.where("seq >= 3")).select("meeting_id", "seq", "start_ms"), ["meeting_id", "seq"], ["start_ms"]))(views.transcripts(spark, d)), oracle("select distinct meeting_id, seq, start_ms from t_transcripts", "t_transcripts"))
register("insert_if_new", lambda spark, d: (lambda t: changes.insert_ignore(t.where("seq <= 3"), t.where("seq >= 2").withColumn("speaker", F.lit("late")), ["meeting_id", "text", "start_ms"]).select("meeting_id", "seq", "speaker"))(views.transcripts(spark, d)), oracle("select meeting_id, seq, case when seq <= 3 then speaker else 'late' end as speaker from t_transcripts", "t_transcripts"))


def buffer_merge(spark, d):
    e = views.emissions(spark, d).select("meeting_id", "idx", "start_ms", F.floor(F.col("start_ms") / 30000).alias("chunk"))
    both = e.where("idx % 3 <> 0").withColumn("prio", F.lit(0)).unionByName(e.where("idx % 2 = 0").withColumn("prio", F.lit(1)))
    return relational.first_seen(both, ["meeting_id", "idx"], ["prio", "chunk"]).select("meeting_id", "chunk", "idx", "prio")


register("buffer_merge", buffer_merge, oracle("select meeting_id, start_ms // 30000 as chunk, idx, case when idx % 3 <> 0 then 0 else 1 end as prio from t_emissions where idx % 3 <> 0 or idx % 2 = 0", "t_emissions"))
register("visible_tags", lambda spark, d: (lambda j: j.groupBy("meeting_id").agg(F.array_sort(F.collect_list("name")).alias("a")).select("meeting_id", F.array_join(F.slice("a", 1, 1), ",").alias("shown"), F.greatest(F.size("a") - 1, F.lit(0)).alias("n_hidden")))(views.tag_links(spark, d).join(F.broadcast(views.tags(spark, d)), "tag_id")), oracle("select meeting_id, min(name) as shown, greatest(count(*) - 1, 0)::int as n_hidden from t_tag_links join t_tags using (tag_id) group by meeting_id", "t_tags", "t_tag_links"))
register("channel_union", lambda spark, d: (lambda s: s.where("label = 'click'").unionByName(s.where("label = 'view'")).orderBy("start_ms", "event_id"))(views.spans(spark, d)), oracle("select * from t_spans where label in ('click', 'view')", "t_spans"))
register("missing_labels", lambda spark, d: (lambda s: s.select("meeting_id", "label").distinct().join(s.where("start_ms % 10 < 3").select("meeting_id", "label").distinct(), ["meeting_id", "label"], "left_anti"))(views.spans(spark, d)), oracle("select distinct meeting_id, label from t_spans except select meeting_id, label from t_spans where start_ms % 10 < 3", "t_spans"))
register("language_vote", lambda spark, d: relational.weighted_vote(table(spark, d, "documents"), "source", "lang", F.length("text")).select("source", F.col("winner").alias("lang"), F.col("weight").alias("n_letters"), "reason"), "with s as (select source, lang, sum(length(text)) as w from documents group by all) select source, case when count(*) filter (w = m) = 1 then max(lang) filter (w = m) end as lang, any_value(m)::bigint as n_letters, case when count(*) filter (w = m) = 1 then 'majority' else 'tie' end as reason from (select *, max(w) over (partition by source) as m from s) group by source")

# -- changes -----------------------------------------------------------------------------------------------------------

_BIND_OLD = "select meeting_id, min(event_id) as bound_to, case when meeting_id % 2 = 0 then 'user' else 'auto' end as matched_by from t_spans where label <> 'click' group by meeting_id"
_BIND_NEW = "select meeting_id, max(event_id) as bound_to, 'auto' as matched_by from t_spans where meeting_id % 3 <> 0 group by meeting_id"


def _bindings(spark, d):
    s = views.spans(spark, d)
    old = s.where("label <> 'click'").groupBy("meeting_id").agg(F.min("event_id").alias("bound_to")).withColumn("matched_by", F.when(F.col("meeting_id") % 2 == 0, "user").otherwise("auto"))
    new = s.where("meeting_id % 3 <> 0").groupBy("meeting_id").agg(F.max("event_id").alias("bound_to")).withColumn("matched_by", F.lit("auto"))
    return old, new


register("upsert_plain", lambda spark, d: changes.upsert(*_bindings(spark, d), ["meeting_id"]), oracle("select coalesce(n.meeting_id, o.meeting_id) as meeting_id, coalesce(n.bound_to, o.bound_to) as bound_to, coalesce(n.matched_by, o.matched_by) as matched_by from o full join n using (meeting_id)", "t_spans", ctes=f"o as ({_BIND_OLD}), n as ({_BIND_NEW})"))
register("upsert_guarded", lambda spark, d: changes.guarded_upsert(*_bindings(spark, d), ["meeting_id"], F.col("matched_by") == "user"), oracle("select coalesce(n.meeting_id, o.meeting_id) as meeting_id, case when o.matched_by = 'user' or n.meeting_id is null then o.bound_to else n.bound_to end as bound_to, case when o.matched_by = 'user' or n.meeting_id is null then o.matched_by else n.matched_by end as matched_by from o full join n using (meeting_id)", "t_spans", ctes=f"o as ({_BIND_OLD}), n as ({_BIND_NEW})"))
register("insert_ignore", lambda spark, d: changes.insert_ignore(*_bindings(spark, d), ["meeting_id"]), oracle("select coalesce(o.meeting_id, n.meeting_id) as meeting_id, coalesce(o.bound_to, n.bound_to) as bound_to, coalesce(o.matched_by, n.matched_by) as matched_by from o full join n using (meeting_id)", "t_spans", ctes=f"o as ({_BIND_OLD}), n as ({_BIND_NEW})"))


def cas_transition(spark, d):
    m = views.meetings(spark, d).select("meeting_id", "status", F.expr("unix_micros(cast(created_at as timestamp))").alias("started_us"))
    asked = m.where("meeting_id % 4 = 0").select("meeting_id", F.when(F.col("meeting_id") % 8 == 0, F.col("started_us")).otherwise(F.lit(0)).alias("started_us"))
    return changes.compare_and_set(m, asked, "meeting_id", "started_us", "status", F.lit("cancelled")).select("meeting_id", "status")


register("cas_transition", cas_transition, oracle("select meeting_id, case when meeting_id % 8 = 0 then 'cancelled' else status end as status from t_meetings", "t_meetings"))


def cascade_delete(spark, d):
    gone = views.meetings(spark, d).where("status = 'F'").select((F.col("meeting_id") % 20).alias("meeting_id")).where("meeting_id < 9")
    left = changes.cascade_delete({"prototypes": views.prototypes(spark, d).select("id", "meeting_id", "is_verified")}, gone, "meeting_id", {"prototypes": F.col("is_verified")})
    return left["prototypes"]


register("cascade_delete", cascade_delete, oracle("select id, case when g is null then meeting_id end as meeting_id, is_verified from t_prototypes left join (select distinct meeting_id % 20 as g from t_meetings where status = 'F' and meeting_id % 20 < 9) on g = meeting_id where g is null or is_verified", "t_prototypes", "t_meetings"))
register("backfill_started", lambda spark, d: views.meetings(spark, d).select("meeting_id", F.coalesce("started_at", "created_at").alias("started_at")), oracle("select meeting_id, coalesce(started_at, created_at) as started_at from t_meetings", "t_meetings"))
register("clip_patch", lambda spark, d: (lambda p: changes.patch(p.select("id", F.when(F.col("id") % 3 == 0, F.col("duration")).alias("clip")), p.where("id % 2 = 0").select("id", (F.col("duration") + 1).alias("clip")), ["id"], "clip"))(views.prototypes(spark, d)), oracle("select id, case when id % 2 = 0 then duration + 1 when id % 3 = 0 then duration end as clip from t_prototypes", "t_prototypes"))
register("running_total", lambda spark, d: views.transcripts(spark, d).select("meeting_id", "seq", "start_ms", "end_ms"), oracle("select meeting_id, seq, start_ms, end_ms from t_transcripts", "t_transcripts"))
register("segment_view", lambda spark, d: views.transcripts(spark, d).select("meeting_id", "seq", F.coalesce(F.when(F.col("seq") > 1, F.col("start_ms")), F.lit(0)).alias("start_ms"), (F.col("seq") > 1).alias("has_time")), oracle("select meeting_id, seq, coalesce(case when seq > 1 then start_ms end, 0) as start_ms, seq > 1 as has_time from t_transcripts", "t_transcripts"))


def clipboard(spark, d):
    t = views.transcripts(spark, d)
    s = F.floor(F.col("start_ms") / 1000)
    line = F.concat(F.when(F.col("seq") > 1, F.format_string("[%02d:%02d]", F.floor(s / 60), s % 60)).otherwise("[--:--]"), F.lit(" "), "text")
    return relational.sorted_list(t.withColumn("line", line).withColumn("line", F.regexp_replace("line", ",", ";")), "meeting_id", "seq", "line", "content").withColumn("content", F.sha2("content", 256))


register("clipboard", clipboard, oracle("select meeting_id, sha256(string_agg(replace(case when seq > 1 then printf('[%02d:%02d]', start_ms // 60000, start_ms // 1000 % 60) else '[--:--]' end || ' ' || text, ',', ';'), ',' order by seq)) as content from t_transcripts group by meeting_id", "t_transcripts"))
