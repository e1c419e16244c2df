"""Queries of naming and recognition: visible names, row recognition, labels by position, filters, crops, costs, reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import intervals as iv
from ..operators import metrics as m
from ..operators import relational, visible
from ..operators import vectors as v
from ..session import table
from ..sources import files, views
from ..sources.views import oracle
from ..streaming import runner
from .evaluation import _DER
from .registry import register
from .texts import CHUNKS_SQL

KEY = ["meeting_id"]

# -- visible names -----------------------------------------------------------------------------------------------------


def visible_speakers(spark, d):
    """Blocks of a meeting under pins, bindings and window overrides, neighbours of one visible name merged before and after."""
    s = views.spans(spark, d)
    blocks = visible.as_blocks(s.where("label <> 'signup'").withColumn("score", (F.col("event_id") % 100) / 100), KEY, ["start_ms", "event_id"])
    pins = s.where("label = 'click'").groupBy("meeting_id", "label").agg(F.concat(F.lit("Guest "), F.min("event_id") % 3).alias("pin"))
    bindings = s.where("label in ('click', 'view') and meeting_id % 2 = 0").groupBy("meeting_id", "label").agg(F.concat(F.lit("Guest "), F.min("event_id") % 2).alias("bound"))
    windows = s.where("label = 'signup'").select("meeting_id", F.col("event_id").alias("w"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.concat(F.lit("Guest "), F.col("event_id") % 2).alias("given"))
    merged = visible.merge_visible(visible.name_clusters(blocks, pins, bindings, KEY), KEY)
    out = visible.merge_visible(visible.override_windows(merged, windows, KEY), KEY)
    return out.select("meeting_id", "n", "start_ms", "end_ms", "label", F.coalesce("name", "label").alias("shown"), "by_user", F.round("score", 6).alias("score"), F.size("parts").alias("n_parts"))


def _merge_sql(name: str, of: str) -> str:
    return f"""{name}_s as (select *, coalesce(name, label) || by_user as seen from {of}), {name}_r as (select *, sum((seen is distinct from lg)::int) over (partition by meeting_id order by n) as run from (select *, lag(seen) over (partition by meeting_id order by n) as lg from {name}_s)),
{name} as (select meeting_id, row_number() over (partition by meeting_id order by min(n)) as n, min_by(start_ms, n) as start_ms, max_by(end_ms, n) as end_ms, list_max(list_transform(flatten(list(parts order by n)), lambda p, i: {{'d': p.e - p.s, 'i': -i, 'l': p.l}})).l as label, arg_min_null(name, n) as name, bool_and(by_user) as by_user, min(score) as score, flatten(list(parts order by n)) as parts from {name}_r group by meeting_id, run)"""


_VISIBLE = (
    """b0 as (select meeting_id, row_number() over (partition by meeting_id order by start_ms, event_id) as n, start_ms, end_ms, label, (event_id % 100) / 100 as score, [{'l': label, 's': start_ms, 'e': end_ms}] as parts from t_spans where label <> 'signup'),
pin as (select meeting_id, label, 'Guest ' || min(event_id) % 3 as pin from t_spans where label = 'click' group by all), bnd as (select meeting_id, label, 'Guest ' || min(event_id) % 2 as bound from t_spans where label in ('click', 'view') and meeting_id % 2 = 0 group by all),
b1 as (select b0.*, coalesce(pin, bound) as name, coalesce(pin, bound) is not null as by_user from b0 left join pin using (meeting_id, label) left join bnd using (meeting_id, label)),
"""
    + _merge_sql("m1", "b1")
    + """,
wl as (select w.meeting_id, w.event_id as w, 'Guest ' || w.event_id % 2 as given, b.n from t_spans w join m1 b on w.label = 'signup' and b.meeting_id = w.meeting_id and b.start_ms < w.end_ms and w.start_ms < b.end_ms qualify row_number() over (partition by w.event_id order by least(b.end_ms, w.end_ms) - greatest(b.start_ms, w.start_ms) desc, b.n) = 1),
wg as (select meeting_id, n, max_by(given, w) as given from wl group by all),
b2 as (select m1.* exclude (name, by_user), coalesce(given, name) as name, by_user or given is not null as by_user from m1 left join wg using (meeting_id, n)),
"""
    + _merge_sql("m2", "b2")
)
register("visible_speakers", visible_speakers, oracle("select meeting_id, n, start_ms, end_ms, label, coalesce(name, label) as shown, by_user, round(score, 6) as score, len(parts)::int as n_parts from m2", "t_spans", ctes=_VISIBLE))

# -- row recognition ---------------------------------------------------------------------------------------------------


def _heard(spark, d):
    """Voiceprints as they were cut from a meeting: a window on their channel."""
    p = views.prototypes(spark, d)
    start = F.expr("id div 20 * 400 % 9000")
    return p.withColumn("r_start", start).withColumn("r_end", start + (F.col("duration") * 1000).cast("long"))


def _recognised(spark, d):
    """For each turn the best match of the voiceprints that overlap it on its channel, against verified ones."""
    t = views.transcripts(spark, d)
    turns = t.select("meeting_id", F.when(F.col("speaker") == "user", "mic").otherwise("system").alias("channel"), "seq", "start_ms", "end_ms")
    heard = _heard(spark, d)
    pairs = iv.overlap_join(turns, heard.select("meeting_id", "channel", "id", "r_start", "r_end"), ["meeting_id", "channel"]).select("meeting_id", "seq", "id")
    asked = heard.join(pairs.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("q_id"), F.col("channel").alias("q_channel"), F.col("embedding").alias("q_vec"))
    best = v.best_match(asked, heard.where("is_verified").select("id", "speaker_id", "channel", "embedding"), 0.3)
    hits = pairs.join(best, pairs["id"] == best["q_id"])
    top = F.max_by(F.struct("speaker_id", "score"), F.struct("score", -F.col("id"))).alias("b")
    return hits.groupBy("meeting_id", "seq").agg(top).select("meeting_id", "seq", "b.speaker_id", F.round("b.score", 6).alias("score"))


_RECOGNISED = """h as (select *, id // 20 * 400 % 9000 as r_start, id // 20 * 400 % 9000 + (duration * 1000)::bigint as r_end, embedding::double[] as v from t_prototypes),
tn as (select meeting_id, case when speaker = 'user' then 'mic' else 'system' end as channel, seq, start_ms, end_ms from t_transcripts),
pr as (select meeting_id, seq, id from tn join h using (meeting_id, channel) where start_ms < r_end and r_start < end_ms),
cs as (select q.id as q_id, p.speaker_id, q.channel = p.channel as same, list_dot_product(q.v, p.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(p.v, p.v)) as c from (select * from h where id in (select id from pr)) q join h p on p.is_verified and p.id <> q.id),
bm as (select q_id, speaker_id, score from (select q_id, speaker_id, coalesce(max(case when same then c end), max(c)) as score from cs group by all) where true qualify row_number() over (partition by q_id order by score desc, speaker_id) = 1 and score > 0.3),
rr as (select meeting_id, seq, speaker_id, round(score, 6) as score from pr join bm on id = q_id qualify row_number() over (partition by meeting_id, seq order by score desc, id) = 1)"""
register("row_recognition", _recognised, oracle("select * from rr", "t_prototypes", "t_transcripts", ctes=_RECOGNISED))


def row_refresh(spark, d):
    """All automatic matches are cleared and computed anew; turns that a user named keep what they have."""
    t = views.transcripts(spark, d)
    old = t.select("meeting_id", "seq", F.when(F.col("seq") % 5 == 0, F.lit("user")).when(F.col("seq") % 2 == 0, F.lit("auto")).alias("matched_by"), F.when(F.col("seq") % 2 == 0, F.lit(99)).when(F.col("seq") % 5 == 0, F.lit(98)).alias("speaker_id"))
    j = old.join(_recognised(spark, d).withColumnRenamed("speaker_id", "new"), ["meeting_id", "seq"], "left")
    user = F.coalesce(F.col("matched_by") == "user", F.lit(False))
    return j.select("meeting_id", "seq", F.when(user, F.col("speaker_id")).otherwise(F.col("new")).alias("speaker_id"), F.when(user, "user").when(F.col("new").isNotNull(), "auto").alias("matched_by"), F.when(~user, F.col("score")).alias("score"))


register("row_refresh", row_refresh, oracle("select t.meeting_id, t.seq, case when t.seq % 5 = 0 then case when t.seq % 2 = 0 then 99 else 98 end else rr.speaker_id end as speaker_id, case when t.seq % 5 = 0 then 'user' when rr.speaker_id is not null then 'auto' end as matched_by, case when t.seq % 5 <> 0 then score end as score from t_transcripts t left join rr using (meeting_id, seq)", "t_prototypes", "t_transcripts", ctes=_RECOGNISED))


def label_by_position(spark, d):
    """The k-th voiceprint of a meeting takes the label of its k-th span; what has no partner is left out."""
    number = lambda *order: F.row_number().over(Window.partitionBy("meeting_id").orderBy(*order)).alias("k")
    p = views.prototypes(spark, d).select("meeting_id", "id", "duration", number("id"))
    s = views.spans(spark, d).select("meeting_id", "label", number("start_ms", "event_id"))
    return p.join(s, ["meeting_id", "k"]).select("id", "label", F.greatest("duration", F.lit(0.0)).alias("duration"))


register("label_by_position", label_by_position, oracle("select id, label, greatest(duration, 0.0) as duration from (select meeting_id, id, duration, row_number() over (partition by meeting_id order by id) as k from t_prototypes) join (select meeting_id, label, row_number() over (partition by meeting_id order by start_ms, event_id) as k from t_spans) using (meeting_id, k)", "t_prototypes", "t_spans"))

# -- filters and lookups -----------------------------------------------------------------------------------------------

_ASKS = {"all": {}, "mic": {"channel": "mic"}, "early": {"window": (0, 2000)}, "mic_early": {"channel": "mic", "window": (0, 2000)}}


def optional_filters(spark, d):
    """Voiceprints under each combination of the optional filters."""
    h = _heard(spark, d).select("id", "channel", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms"))
    parts = [relational.optional_filters(h, **ask).withColumn("ask", F.lit(name)) for name, ask in _ASKS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("ask", "channel").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


register("optional_filters", optional_filters, oracle("select ask, channel, count(*) as n, min(id) as first_id from (select *, id // 20 * 400 % 9000 as s, id // 20 * 400 % 9000 + (duration * 1000)::bigint as e from t_prototypes) join (values ('all', null, null), ('mic', 'mic', null), ('early', null, 2000), ('mic_early', 'mic', 2000)) a(ask, c, w) on (c is null or channel = c) and (w is null or (s < w and e > 0)) group by all", "t_prototypes"))


def ids_in_order(spark, d):
    """The tags of a stored list of ids, in its order, without those that no longer exist."""
    ids = views.emissions(spark, d).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("event_id") % 40).alias("t")))).alias("s")).select("meeting_id", F.transform("s", lambda y: y["t"]).alias("ids"))
    found = relational.in_order(ids, KEY, "ids", views.tags(spark, d).select(F.col("tag_id").cast("long").alias("tag_id"), "name"), "tag_id")
    return found.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("s")).select("meeting_id", F.array_join(F.transform("s", lambda y: y["name"]), ",").alias("names"))


register("ids_in_order", ids_in_order, oracle("select meeting_id, string_agg(name, ',' order by idx) as names from t_emissions join t_tags on tag_id = event_id % 40 group by meeting_id", "t_emissions", "t_tags"))

# -- annotated regions, costs ------------------------------------------------------------------------------------------


def _regions(spark, d):
    return views.spans(spark, d).where("label = 'error'").select("meeting_id", "start_ms", "end_ms")


_CROPPED = """rg0 as (select * from t_spans where label = 'error' and end_ms > start_ms), rg as (select meeting_id, min(start_ms) as u, max(end_ms) as w from (select *, sum(f) over (partition by meeting_id order by start_ms, end_ms) as i from (select *, case when start_ms <= max(end_ms) over (partition by meeting_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) then 0 else 1 end as f from rg0)) group by meeting_id, i),
cr as (select meeting_id, event_id, label, greatest(start_ms, u) as start_ms, least(end_ms, w) as end_ms from t_reference join rg using (meeting_id) where start_ms < w and u < end_ms), ch as (select meeting_id, event_id, label, greatest(start_ms, u) as start_ms, least(end_ms, w) as end_ms from t_spans join rg using (meeting_id) where start_ms < w and u < end_ms)"""
register("crop_to_regions", lambda spark, d: iv.crop(views.reference(spark, d), _regions(spark, d), KEY), oracle("select meeting_id, event_id, label, start_ms, end_ms from cr", "t_spans", "t_reference", ctes=_CROPPED))
register("der_cropped", lambda spark, d: m.error_components(iv.crop(views.reference(spark, d), _regions(spark, d), KEY), iv.crop(views.spans(spark, d), _regions(spark, d), KEY), KEY), oracle("select * from der", "t_spans", "t_reference", ctes=_CROPPED + ",\n" + _DER.replace("from t_reference", "from cr").replace("from t_spans", "from ch")))


def run_costs(spark, d):
    """Mean real-time factor and stop cost per hour of audio of each kind of run; recorded, never gated."""
    s = views.spans(spark, d).where("end_ms > start_ms").withColumn("audio_s", (F.col("end_ms") - F.col("start_ms")) / 1000)
    s = s.withColumn("cost_s", (F.col("event_id") % 97) / 10).withColumn("stop_s", F.when(F.col("event_id") % 3 == 0, F.col("cost_s") / 5))
    return s.groupBy("label").agg(F.round(F.avg(F.col("cost_s") / F.col("audio_s")), 9).alias("real_time_factor"), F.round(F.sum("stop_s") / F.sum(F.when(F.col("stop_s").isNotNull(), F.col("audio_s"))) * 3600, 9).alias("stop_s_per_hour"))


register("run_costs", run_costs, oracle("select label, round(avg(c / a), 9) as real_time_factor, round(sum(c / 5) filter (event_id % 3 = 0) / sum(a) filter (event_id % 3 = 0) * 3600, 9) as stop_s_per_hour from (select *, (end_ms - start_ms) / 1000 as a, (event_id % 97) / 10 as c from t_spans where end_ms > start_ms) group by label", "t_spans"))

# -- files -------------------------------------------------------------------------------------------------------------


def _present(spark, d):
    return views.transcripts(spark, d).where("meeting_id < 60").groupBy(F.concat(F.lit("meeting-"), F.col("meeting_id").cast("string")).alias("uri")).agg((F.max("end_ms") / 1000).alias("seconds"))


def present_recordings(spark, d):
    """Reference lines of recordings that are there, counted, and the rebuilt region line of each recording."""
    s = views.spans(spark, d).withColumn("uri", F.concat(F.lit("meeting-"), F.col("meeting_id").cast("string")))
    lines, regions = files.present_only(files.rttm_lines(s), _present(spark, d))
    n = lines.groupBy("uri").agg(F.count("*").alias("n_turns"), F.min("value").alias("first_line"))
    return regions.join(n, "uri", "left").select("uri", "value", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), "first_line")


register("present_recordings", present_recordings, oracle("select uri, value, coalesce(n_turns, 0) as n_turns, first_line from (select 'meeting-' || meeting_id as uri, printf('meeting-%d 1 0.0 %.3f', meeting_id, max(end_ms) / 1000) as value from t_transcripts where meeting_id < 60 group by meeting_id) left join (select 'meeting-' || meeting_id as uri, count(*) as n_turns, min(printf('SPEAKER meeting-%d 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', meeting_id, start_ms / 1000, (end_ms - start_ms) / 1000, label)) as first_line from t_spans group by meeting_id) using (uri)", "t_transcripts", "t_spans"))


def corpus_names(spark, d):
    """Meetings behind corpus file names; names of another form have none."""
    series = F.element_at(F.array(*map(F.lit, ("es", "IS", "ib", "ibi", "EN", "ic", "st", "zz"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    number = F.lpad((F.col("p_partkey") % 10_000).cast("string"), 4, "0")
    name = F.concat(series, number, F.element_at(F.array(*map(F.lit, ("a", "", "c", "x"))), (F.col("p_size") % 4 + 1).cast("int")), F.when(F.col("p_size") % 5 == 0, ".wav").when(F.col("p_size") % 5 == 1, "_mix.wav").otherwise(".Mix-Headset.wav"))
    return table(spark, d, "part").select("p_partkey", name.alias("file"), files.meeting_name(name).alias("meeting"))


register("corpus_names", corpus_names, r"select p_partkey, f as file, nullif(upper(regexp_extract(lower(f), p, 1)) || regexp_extract(lower(f), p, 2) || upper(regexp_extract(lower(f), p, 3)), '') as meeting from (select p_partkey, '^(es\d{4}|ibi?\d{4}|en\d{4}|st\d{4})([a-f])[._]|^(ic\d{3}|is\d{4})[._]' as p, (['es', 'IS', 'ib', 'ibi', 'EN', 'ic', 'st', 'zz'])[p_partkey % 8 + 1] || lpad((p_partkey % 10000)::varchar, 4, '0') || (['a', '', 'c', 'x'])[p_size % 4 + 1] || case p_size % 5 when 0 then '.wav' when 1 then '_mix.wav' else '.Mix-Headset.wav' end as f from part)")


def script_file(spark, d):
    """Turns written as a CSV script and read back: a text column is needed, blank texts are dropped."""
    folder = f"{runner.shared_folder(spark)}/script-{uuid.uuid4().hex}"
    t = views.transcripts(spark, d).select("meeting_id", "seq", F.when(F.col("seq") % 4 == 3, F.lit("  ")).otherwise(F.col("text")).alias("text"))
    t.write.option("header", True).option("escape", '"').csv(folder)
    return files.read_script(spark, folder).select(F.col("meeting_id").cast("long").alias("meeting_id"), F.col("seq").cast("long").alias("seq"), F.sha2("text", 256).alias("text_sha256"))


register("script_file", script_file, oracle("select meeting_id, seq::bigint as seq, sha256(text) as text_sha256 from t_transcripts where seq % 4 <> 3 and trim(text) <> ''", "t_transcripts"))


def report_lines(spark, d):
    """A Markdown table of the error rates by meeting, with the baselines that are known."""
    c = m.error_components(views.reference(spark, d), views.spans(spark, d), KEY)
    percent = lambda part: F.round(part * 100 / F.col("total"), 2)
    s = c.select("meeting_id", percent(F.col("miss") + F.col("false_alarm") + F.col("confusion")).alias("der"), percent(F.col("false_alarm")).alias("fa"), percent(F.col("miss")).alias("miss"), percent(F.col("confusion")).alias("conf"), F.when(F.col("meeting_id") % 3 != 0, F.lit(25.3)).alias("baseline"))
    return files.report_lines(s, "meeting_id", "baseline")


register("report_lines", report_lines, oracle("select * from (values (-2::bigint, '| Dataset | DER % | FA % | Miss % | Conf % | Baseline % | Difference |'), (-1, '| --- | ---: | ---: | ---: | ---: | ---: | ---: |')) h(pos, value) union all select meeting_id, printf('| %d | %.2f | %.2f | %.2f | %.2f | %s |', meeting_id, r, fa, mi, co, case when meeting_id % 3 = 0 then 'n/a | n/a' else printf('25.3 | %+.2f', r - 25.3) end) from (select meeting_id, round((miss + false_alarm + confusion) * 100 / total, 2) as r, round(false_alarm * 100 / total, 2) as fa, round(miss * 100 / total, 2) as mi, round(confusion * 100 / total, 2) as co from der)", "t_spans", "t_reference", ctes=_DER))

# -- texts -------------------------------------------------------------------------------------------------------------


def combined_summaries(spark, d, summarise=lambda chunk: F.substring(chunk, 1, 60)):
    """Each document's chunks summarised by a column function and joined in their order."""
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(x.overlap_chunks(1400, 140)("text")).alias("k", "c"))
    parts = chunks.select("doc_id", "k", F.trim(summarise(F.col("c.chunk"))).alias("s")).where("s <> ''")
    return parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda y: y["s"]), "\n---\n").alias("combined"))


register("combined_summaries", combined_summaries, CHUNKS_SQL + "select doc_id, string_agg(s, chr(10) || '---' || chr(10) order by k) as combined from (select doc_id, k, trim(substring(text, a + 1, least(60, e - a))) as s from ch) where s <> '' group by doc_id")


# -- small rules -------------------------------------------------------------------------------------------------------


def channel_state(available, efficient, system, has_system_device, engine_disabled, chunks, turns, ordered):
    """The state that a channel's counters and its session show, the first that applies."""
    return F.when(~available, "unavailable").when(system & ~has_system_device, "inactive").when(engine_disabled & (chunks > 0), "error").when(efficient, "deferred").when((turns > 0) & ordered, "healthy").when(turns > 0, "warning").otherwise("accumulating")


def session_states(spark, d):
    """Both channels of every user's session: clicks and views come over the microphone, the rest over the system."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "system").orderBy("event_id")
    e = e.withColumn("system", ~F.col("event_type").isin("click", "view")).withColumn("back", F.lag("ts").over(w) > F.col("ts"))
    c = e.groupBy("user_id", "system").agg(F.count("*").alias("chunks"), F.count_if(F.col("event_type").isin("view", "purchase")).alias("turns"), (~F.coalesce(F.bool_or("back"), F.lit(False))).alias("ordered"))
    u = F.col("user_id")
    state = channel_state(u % 13 != 0, u % 5 == 1, F.col("system"), u % 7 != 0, u % 11 == 0, F.col("chunks"), F.col("turns"), F.col("ordered"))
    return c.select("user_id", "system", state.alias("state"))


register("session_states", session_states, "select user_id, system, case when user_id % 13 = 0 then 'unavailable' when system and user_id % 7 = 0 then 'inactive' when user_id % 11 = 0 and chunks > 0 then 'error' when user_id % 5 = 1 then 'deferred' when turns > 0 and ordered then 'healthy' when turns > 0 then 'warning' else 'accumulating' end as state from (select user_id, system, count(*) as chunks, count(*) filter (event_type in ('view', 'purchase')) as turns, not coalesce(bool_or(back), false) as ordered from (select *, lag(ts) over (partition by user_id, system order by event_id) > ts as back from (select *, event_type not in ('click', 'view') as system from events)) group by all)")
register("gap_merge_confidence", lambda spark, d: iv.merge_gaps(views.spans(spark, d).withColumn("confidence", F.col("event_id") % 101), KEY, 600_000, ["start_ms", "event_id"], lowest=("confidence",)), oracle("select meeting_id, min(start_ms) as start_ms, max_by(end_ms, (start_ms, event_id)) as end_ms, count(*) as n_merged, min(event_id % 101) as confidence from (select *, sum(f) over (partition by meeting_id order by start_ms, event_id) as i from (select *, case when lag(end_ms) over w is null or start_ms - lag(end_ms) over w >= 600000 then 1 else 0 end as f from t_spans window w as (partition by meeting_id order by start_ms, event_id))) group by meeting_id, i", "t_spans"))
register("clock_formats", lambda spark, d: table(spark, d, "events").select("event_id", x.wall_clock(F.expr("unix_micros(cast(ts as timestamp)) div 1000000")).alias("clock"), x.minute_stamp(F.when(F.col("event_id") % 6 != 0, F.col("ts").cast("string")).otherwise(F.col("event_type"))).alias("minute")), "select event_id, strftime(ts, '%H:%M:%S') as clock, case when event_id % 6 <> 0 then strftime(ts, '%Y-%m-%d %H:%M') else '--' end as minute from events")
register("fresh_levels", lambda spark, d: views.prototypes(spark, d).select("id", F.when(F.col("id") * 37 % 1000 > 500, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (20 * F.log10(F.sqrt(v.dot(F.col("embedding"), F.col("embedding")) / F.size("embedding"))) + 60) / 60)), 6)).alias("level")), oracle("select id, case when id * 37 % 1000 > 500 then 0.0 else round(least(1.0, greatest(0.0, (20 * log10(sqrt(list_dot_product(embedding::double[], embedding::double[]) / len(embedding))) + 60) / 60)), 6) end as level", "t_prototypes").replace("end as level", "end as level from t_prototypes"))


def dropped_by_coherence(spark, d):
    """How many of each speaker's reachable rows the pick leaves out."""
    p = views.prototypes(spark, d)
    reach = p.groupBy("speaker_id").agg(F.least(F.count("*"), F.lit(16)).alias("reach"))
    picked = v.coherent_pick(p, "speaker_id", "id", "embedding", "duration", 16, 8, -0.05).groupBy("speaker_id").agg(F.count("*").alias("picked"))
    return reach.join(picked, "speaker_id", "left").select("speaker_id", (F.col("reach") - F.coalesce("picked", F.lit(0))).alias("dropped"))


_POOL = """tp as (select *, embedding::double[] as e from t_prototypes qualify row_number() over (partition by speaker_id order by duration desc, id) <= 16),
un as (select id, speaker_id, list_transform(e, lambda q: q / sqrt(list_dot_product(e, e))) as u from tp),
sm as (select speaker_id, max(n) as n, list(s order by pos) as total from (select speaker_id, pos, sum(q) as s, count(*) as n from (select speaker_id, unnest(u) as q, generate_subscripts(u, 1) as pos from un) group by all) group by speaker_id),
ow as (select id, speaker_id, n, list_dot_product(u, o) / sqrt(list_dot_product(o, o)) as own from (select un.*, n, list_transform(list_zip(total, u), lambda z: z[1] - z[2]) as o from un join sm using (speaker_id)))"""
register("dropped_by_coherence", dropped_by_coherence, oracle("select speaker_id, count(*) - least(8, count(*) filter (n < 3 or own >= -0.05)) as dropped from ow group by speaker_id", "t_prototypes", ctes=_POOL))


def mode_deltas(spark, d):
    """Metrics of the whole timeline (offline) and of what was stable live (online), and by how much they differ."""
    one = lambda rows, name: rows.groupBy("meeting_id").agg((F.avg(F.col("end_ms") - F.col("start_ms")) / 60000).alias("mean_minutes"), F.nullif(F.count_if(F.col("label") == "click"), F.lit(0)).cast("double").alias("clicks")).unpivot("meeting_id", ["mean_minutes", "clicks"], "metric", name)
    e = views.emissions(spark, d)
    j = one(e, "offline").join(one(e.where("stable"), "online"), ["meeting_id", "metric"], "full")
    return j.select("meeting_id", "metric", F.round("offline", 6).alias("offline"), F.round("online", 6).alias("online"), F.round(F.col("online") - F.col("offline"), 6).alias("delta"))


_MODES = ", ".join(f"m{k} as (select meeting_id, unnest(['mean_minutes', 'clicks']) as metric, unnest([avg(end_ms - start_ms) / 60000, nullif(count(*) filter (label = 'click'), 0)::double]) as v from t_emissions where {w} group by meeting_id)" for k, w in enumerate(("true", "stable")))
register("mode_deltas", mode_deltas, oracle("select meeting_id, metric, round(m0.v, 6) as offline, round(m1.v, 6) as online, round(m1.v - m0.v, 6) as delta from m0 full join m1 using (meeting_id, metric)", "t_emissions", ctes=_MODES))


def display_scores(spark, d):
    """The score of the level that names each turn: the row's own match, or its cluster's."""
    t = views.transcripts(spark, d)
    s = F.col("seq")
    score = relational.display_score(s % 7 == 0, F.when(s % 3 != 2, F.col("meeting_id") % 2 == 0), s % 2 == 0, s / 100, F.when(F.col("meeting_id") % 5 != 0, F.col("meeting_id") / 1000))
    return t.select("meeting_id", "seq", F.round(score, 6).alias("score"))


register("display_scores", display_scores, oracle("select meeting_id, seq, round(case when seq % 7 <> 0 and not coalesce(case when seq % 3 <> 2 then meeting_id % 2 = 0 end, false) and seq % 2 = 0 then seq / 100 else case when meeting_id % 5 <> 0 then meeting_id / 1000 end end, 6) as score from t_transcripts", "t_transcripts"))
