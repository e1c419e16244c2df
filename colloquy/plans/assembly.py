"""Queries of sequential operators and of file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sequences as sq
from ..session import table
from ..sources import files, views
from ..sources.views import oracle
from .registry import register


def _said_spans(t):
    """Speaker spans over a meeting: the turns 1.3 s later, without every third one, so that tokens fall between spans."""
    kept = t.where("seq % 3 <> 2")
    return kept.select("meeting_id", (F.col("start_ms") + 1300).alias("r_start"), (F.col("end_ms") + 1300).alias("r_end"), F.col("speaker").alias("r_label"), F.col("seq").alias("r_id"))


def _tokens_with_speakers(spark, d):
    t = views.transcripts(spark, d)
    tokens = sq.exploded_tokens(t, ["meeting_id", "seq"], "text")
    who = iv.attribute(tokens, _said_spans(t), ["meeting_id"], ["seq", "pos"], ["r_start", "r_id"], "r_label", 1500)
    return who.withColumn("speaker", F.col("assigned"))


def token_split(spark, d):
    """Turns cut into blocks by the speakers whose spans lie over their tokens, or nearest to them."""
    return sq.split_rows(_tokens_with_speakers(spark, d), ["meeting_id", "seq"]).select("meeting_id", "seq", "block", "speaker", "start_ms", "end_ms", F.sha2("text", 256).alias("text_sha256"))


_SAID = "sp as (select meeting_id, start_ms + 1300 as r_start, end_ms + 1300 as r_end, speaker as r_label, seq as r_id from t_transcripts where seq % 3 <> 2)"


def _attribute_sql(name: str, rows: str, ident: str, most: int) -> str:
    """{name}: rows with the label of the span they overlap most, else of their meeting's only one, else of the nearest."""
    return f"""{name}_p as (select {ident}, r_label, r_start, r_id, least(end_ms, r_end) - greatest(start_ms, r_start) as ov, greatest(start_ms - r_end, r_start - end_ms, 0) as gap from {rows} join sp using (meeting_id)),
{name}_h as (select {ident}, r_label as hit from {name}_p where ov > 0 qualify row_number() over (partition by {ident} order by ov desc, r_start, r_id) = 1),
{name}_o as (select meeting_id, min(r_label) as lone from sp group by meeting_id having min(r_label) = max(r_label)),
{name}_g as (select {ident}, r_label as near from {name}_p where gap <= {most} qualify row_number() over (partition by {ident} order by gap, r_start, r_id) = 1),
{name} as (select r.*, coalesce(hit, lone, near) as assigned, case when hit is not null then 'overlap' when lone is not null then 'only' when near is not null then 'nearest' end as how from {rows} r left join {name}_h using ({ident}) left join {name}_o using (meeting_id) left join {name}_g using ({ident}))"""


_SPLIT = _SAID + r""",
tk as (select meeting_id, seq, pos, w[pos + 1] as text, start_ms + (end_ms - start_ms) * pos // len(w) as start_ms, start_ms + (end_ms - start_ms) * (pos + 1) // len(w) as end_ms, meeting_id * 1000000000 + seq * 1000000 + pos as tid from (select *, unnest(range(len(w)))::bigint as pos from (select *, regexp_extract_all(text, '[^ \t\r\n\f\x0B]+') as w from t_transcripts))),
""" + _attribute_sql("ta", "tk", "tid", 1500) + """,
t1 as (select *, count(assigned) over (w rows between unbounded preceding and current row) as so_far, lead(assigned) over w as nxt from ta window w as (partition by meeting_id, seq order by pos)),
t2 as (select *, case when assigned is not null and (so_far = 1 or nxt = assigned) then assigned end as named from t1),
t3 as (select *, named is not null and named is distinct from last_value(named ignore nulls) over (partition by meeting_id, seq order by pos rows between unbounded preceding and 1 preceding) as new from t2),
t4 as (select *, sum(new::int) over (partition by meeting_id, seq order by pos) - 1 as block from t3),
bk as (select meeting_id, seq, block::int as block, min_by(assigned, pos) as speaker, min(start_ms) as start_ms, max(end_ms) as last_ms, string_agg(text, ' ' order by pos) as text from t4 where block >= 0 group by meeting_id, seq, block),
b2 as (select *, coalesce(lead(start_ms) over (partition by meeting_id, seq order by block), last_ms) as end_ms from bk)"""
register("token_split", token_split, oracle("select meeting_id, seq, block, speaker, start_ms, end_ms, sha256(text) as text_sha256 from b2", "t_transcripts", ctes=_SPLIT))


def split_expansion(spark, d):
    """The rows of split turns with derived ids and places, each labelled by the span it overlaps most or is nearest to."""
    t = views.transcripts(spark, d)
    cut = sq.split_rows(_tokens_with_speakers(spark, d), ["meeting_id", "seq"]).withColumn("id", F.concat_ws("/", "meeting_id", "seq"))
    rows = sq.expand_rows(cut.select("meeting_id", "id", "seq", "block", "start_ms", "end_ms"), "id", "seq")
    return iv.attribute(rows, _said_spans(t), ["meeting_id"], ["id"], ["r_start", "r_id"], "r_label", 30_000).select("id", "seq", "assigned", "how")


_EXPANDED = _SPLIT + ", ex as (select meeting_id, start_ms, end_ms, meeting_id || '/' || seq || case when block > 0 then '_split' || block else '' end as id, seq + case when block > 0 then block * 10000 + 1000 else 0 end as place from b2),\n" + _attribute_sql("ea", "ex", "id", 30_000)
register("split_expansion", split_expansion, oracle("select id, place as seq, assigned, how from ea", "t_transcripts", ctes=_EXPANDED))


def greedy_labels(spark, d):
    h = views.spans(spark, d).select("meeting_id", F.col("label").alias("live"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    shared = iv.overlap_join(views.reference(spark, d).select("meeting_id", "label", "start_ms", "end_ms"), h, ["meeting_id"]).groupBy("meeting_id", "label", "live").agg(F.sum("overlap_ms").alias("w"))
    return sq.greedy_matches(shared, ["meeting_id"], "label", "live", "w")


# Each step takes the largest weight whose labels are both free.
_GREEDY = """w as (select r.meeting_id, r.label, h.label as live, sum(least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)) as w from t_reference r join t_spans h on h.meeting_id = r.meeting_id and h.start_ms < r.end_ms and r.start_ms < h.end_ms group by all),
g as (select distinct meeting_id, []::varchar[] as ls, []::varchar[] as rs, null::varchar as label, null::varchar as live from w union all select g.meeting_id, list_append(ls, w.label), list_append(rs, w.live), w.label, w.live from g join w on w.meeting_id = g.meeting_id and not list_contains(ls, w.label) and not list_contains(rs, w.live) qualify row_number() over (partition by g.meeting_id order by w desc, w.label, w.live) = 1)"""
register("greedy_labels", greedy_labels, oracle("select meeting_id, label, g.live from (select distinct meeting_id, label from w) left join g using (meeting_id, label)", "t_spans", "t_reference", ctes=_GREEDY).replace("with t_spans", "with recursive t_spans", 1))


def _shared_labels(spark, d, live_labels):
    h = views.spans(spark, d).where(F.col("label").isin(*live_labels)).select("meeting_id", F.col("label").alias("live"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return iv.overlap_join(views.reference(spark, d).select("meeting_id", "label", "start_ms", "end_ms"), h, ["meeting_id"]).groupBy("meeting_id", "label", "live").agg(F.sum("overlap_ms").alias("w"))


_LONG_MS = 7_200_000
_LIVE = ("click", "purchase", "view")
_LIVE_SQL = _GREEDY.replace("join t_spans h on", f"join t_spans h on h.label in {_LIVE} and")
register("greedy_fresh", lambda spark, d: sq.with_fresh(sq.greedy_matches(_shared_labels(spark, d, _LIVE), ["meeting_id"], "label", "live", "w"), ["meeting_id"], "label", "live"), oracle("select meeting_id, label, coalesce(live, 'new-' || count(*) filter (live is null) over (partition by meeting_id order by label)) as live from (select meeting_id, label, g.live from (select distinct meeting_id, label from w) left join g using (meeting_id, label))", "t_spans", "t_reference", ctes=_LIVE_SQL).replace("with t_spans", "with recursive t_spans", 1))


def labels_apart(spark, d):
    """Reference labels to three live ones: those whose long turns overlap in a meeting may not share one; the rest gets new names."""
    r = views.reference(spark, d).where(f"end_ms - start_ms >= {_LONG_MS}").select("meeting_id", F.col("label").alias("a"), "start_ms", "end_ms")
    other = r.select("meeting_id", F.col("a").alias("b"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    apart = iv.overlap_join(r, other, ["meeting_id"]).where("a < b").select("meeting_id", "a", "b").distinct()
    return sq.with_fresh(sq.matches_apart(_shared_labels(spark, d, _LIVE), apart, ["meeting_id"], "label", "live", "w").where("meeting_id is not null"), ["meeting_id"], "label", "live")


# Every mapping of a meeting's labels to the live ones or none, without those that let two labels meet that must not.
_APART = _LIVE_SQL.split(",\ng as (")[0] + f""",
ap as (select distinct x.meeting_id, x.label as a, y.label as b from t_reference x join t_reference y on x.end_ms - x.start_ms >= {_LONG_MS} and y.end_ms - y.start_ms >= {_LONG_MS} and x.meeting_id = y.meeting_id and x.label < y.label and x.start_ms < y.end_ms and y.start_ms < x.end_ms),
ll as (select meeting_id, label, row_number() over (partition by meeting_id order by label) as k from (select distinct meeting_id, label from w)),
mp as (select meeting_id, 0 as k, []::varchar[] as ls, []::varchar[] as gs, 0::hugeint as s from (select distinct meeting_id from w)
  union all select mp.meeting_id, mp.k + 1, list_append(ls, ll.label), list_append(gs, o.g), s + coalesce((select w.w from w where w.meeting_id = mp.meeting_id and w.label = ll.label and w.live = o.g), 0)
  from mp join ll on ll.meeting_id = mp.meeting_id and ll.k = mp.k + 1, (select unnest(['click', 'purchase', 'view', '~']) as g) o
  where o.g = '~' or (exists (select 1 from w where w.meeting_id = mp.meeting_id and w.label = ll.label and w.live = o.g) and not exists (select 1 from ap where ap.meeting_id = mp.meeting_id and ap.b = ll.label and list_contains(ls, ap.a) and gs[list_position(ls, ap.a)] = o.g))),
bm as (select meeting_id, unnest(ls) as label, nullif(unnest(gs), '~') as live from (select * from mp where k = (select max(k) from ll where ll.meeting_id = mp.meeting_id) qualify row_number() over (partition by meeting_id order by s desc, array_to_string(gs, ',')) = 1))"""
register("labels_apart", labels_apart, oracle("select meeting_id, label, coalesce(live, 'new-' || count(*) filter (live is null) over (partition by meeting_id order by label)) as live from bm", "t_spans", "t_reference", ctes=_APART).replace("with t_spans", "with recursive t_spans", 1))
register("cluster_least", lambda spark, d: sq.cluster_vectors(views.prototypes(spark, d), ["meeting_id", "channel"], "id", "embedding", 0.25, least=2).select("meeting_id", "channel", "id", "cluster"))
register("cluster_blocks", lambda spark, d: sq.cluster_in_blocks(views.prototypes(spark, d), ["channel"], "id", "embedding", 0.25).select("channel", "id", "cluster"))


def level_pieces(spark, d):
    """The levels of each kind of event in their order, cut near every 400th where they are lowest."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("v")))).alias("s"))
    pieces = sq.pieces_near(400, 60, 4, 1, 20, 1500.0, 20)(F.transform("s", lambda x: x["v"]))
    return e.select("event_type", F.posexplode(pieces).alias("k", "p")).select("event_type", "k", "p.from_sample", "p.to_sample")


_PIECES = """ev as (select event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as i, round(value * 100)::bigint as v from events), n as (select event_type, count(*) as n from ev group by event_type),
en as (select event_type, i, sum(v * v) over (partition by event_type order by i rows between current row and 3 following) as e from ev),
ct as (select event_type, 0 as k, 0::bigint as a, null::bigint as b from n
  union all select event_type, k + 1, b, b from (select q.event_type, q.k, case when q.n - q.a <= 400 then q.n when q.i is null or q.e > 1500.0 * 1500.0 * 4 then least(coalesce(q.i + 2, q.a + 400) + 20, q.n) else q.i + 2 end as b
    from (select ct.event_type, ct.k, ct.a, n.n, en.i, en.e from ct join n using (event_type) left join en on en.event_type = ct.event_type and en.i >= greatest(ct.a + 340, ct.a + 20) and en.i + 4 <= least(ct.a + 460, n.n - 4) where ct.a < n.n qualify row_number() over (partition by ct.event_type order by en.e, en.i) = 1) q))"""
register("level_pieces", level_pieces, f"with recursive {_PIECES} select x.event_type, x.k, x.a::int as from_sample, y.a::int as to_sample from ct x join ct y on y.event_type = x.event_type and y.k = x.k + 1")
register("cluster_vectors", lambda spark, d: sq.cluster_vectors(views.prototypes(spark, d), ["meeting_id", "channel"], "id", "embedding", 0.25).select("meeting_id", "channel", "id", "cluster"))
register("pack_spans", lambda spark, d: sq.pack_spans(views.transcripts(spark, d).select("meeting_id", "seq", "start_ms", "end_ms"), ["meeting_id"], ["seq"], 250_000, 300), oracle("select meeting_id, seq, start_ms, end_ms, pack from p", "t_transcripts", ctes="n as (select meeting_id, seq, start_ms, end_ms, end_ms - start_ms as len, row_number() over (partition by meeting_id order by seq) as i from t_transcripts), p as (select *, 0 as pack, len as used from n where i = 1 union all select n.*, case when used + 300 + n.len > 250000 then pack + 1 else pack end, case when used + 300 + n.len > 250000 then n.len else used + 300 + n.len end from p join n on n.meeting_id = p.meeting_id and n.i = p.i + 1)").replace("with t_transcripts", "with recursive t_transcripts", 1))


register("quiet_cuts", lambda spark, d: views.prototypes(spark, d).select("id", sq.quiet_cut_places(24, 4, 1)("embedding").alias("cuts")).select("id", F.array_join(F.transform("cuts", lambda c: c.cast("string")), ",").alias("cuts")))


def voted_text(spark, d):
    t = views.transcripts(spark, d).withColumn("turn_id", F.concat_ws("/", "meeting_id", "seq"))
    a = t.select("turn_id", F.lit("a").alias("source"), "text")
    b = t.select("turn_id", F.lit("b").alias("source"), F.regexp_replace("text", "th", "d").alias("text"))
    c = t.select("turn_id", F.lit("c").alias("source"), F.regexp_replace("text", "th", "d").alias("text"))
    return sq.weave_sources(files.union_sources({"a": a, "b": b, "c": c}), "turn_id", "source", "text", "a").select("turn_id", F.sha2("voted", 256).alias("voted_sha256"))


register("voted_text", voted_text, oracle("select meeting_id || '/' || seq as turn_id, sha256(array_to_string(list_filter(regexp_split_to_array(replace(text, 'th', 'd'), '\\s+'), lambda y: y <> ''), ' ')) as voted_sha256 from t_transcripts", "t_transcripts"))


def rttm_round_trip(spark, d):
    s = views.spans(spark, d).withColumn("uri", F.concat(F.lit("meeting-"), F.col("meeting_id").cast("string")))
    return files.parse_rttm(files.rttm_lines(s))


register("rttm_round_trip", rttm_round_trip, oracle("select 'meeting-' || meeting_id as uri, start_ms, end_ms, label, true as valid from t_spans", "t_spans"))


def sidecar_round_trip(spark, d):
    e = views.emissions(spark, d)
    rows = e.select(F.col("meeting_id").cast("string").alias("uri"), F.col("idx").alias("index"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("label").alias("speaker"), "stable")
    return files.parse_sidecar(files.sidecar_lines(rows)).select("uri", "index", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.round(F.col("end") * 1000).cast("long").alias("end_ms"), "speaker", "stable")


register("sidecar_round_trip", sidecar_round_trip, oracle('select meeting_id::varchar as uri, idx as "index", start_ms, end_ms, label as speaker, stable from t_emissions', "t_emissions"))
register("speaker_explode", lambda spark, d: files.explode_speakers(views.spans(spark, d).groupBy(F.col("meeting_id").cast("string").alias("uri")).agg(F.collect_list(F.struct("label", "start_ms", F.when(F.col("event_id") % 9 == 0, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"))).alias("speakers"))), oracle("select meeting_id::varchar as uri, label, start_ms, end_ms from t_spans where event_id % 9 <> 0 and end_ms > start_ms", "t_spans"))
register("export_lines", lambda spark, d: files.parse_export(table(spark, d, "conversations").select(F.concat("role", F.lit(": "), F.regexp_replace("text", "\n", " ")).alias("value"))).groupBy("speaker").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")), "select role as speaker, count(*) as n, sum(length(text))::bigint as n_chars from conversations group by role")
register("preferred_files", lambda spark, d: files.preferred_files(table(spark, d, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 40).cast("string"), F.lit("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, ".flac").when(F.col("p_size") % 3 == 1, ".mp4").otherwise(".txt")).alias("name"))).select("stem", "number", "ext"), "with n as (select 'm' || p_partkey % 40 as stem, p_partkey::int as number, case when p_size % 3 = 0 then 'flac' else 'mp4' end as ext from part where p_size % 3 <> 2) select stem, number, ext from n where ext = (select min(ext) from n m where m.stem = n.stem)")
