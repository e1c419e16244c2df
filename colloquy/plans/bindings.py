"""Queries that change who is who: replaced speakers, enrolment, tags by name; headings; packs mapped back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import bindings as b
from ..operators import sequences as sq
from ..operators import vectors as v
from ..session import table
from ..sources import views
from ..sources.views import oracle
from .registry import register

_SOURCE, _THRESHOLD = 3, 0.1


def _bindings(p):
    """Each meeting's channels as clusters, bound to the speaker of their longest row; some by users, some to nobody."""
    k = F.col("meeting_id")
    own = p.groupBy("meeting_id", F.col("channel").alias("cluster")).agg(F.max_by("speaker_id", F.struct("duration", "id")).alias("speaker_id"))
    return own.select("meeting_id", "cluster", F.when(k % 7 != 6, F.when(k % 4 == 1, _SOURCE).otherwise(F.col("speaker_id"))).cast("int").alias("speaker_id"), F.when(k % 5 == 0, "user").otherwise("auto").alias("matched_by"), F.lit(0.5).alias("score"))


_BOUND = f"""bd as (select meeting_id, channel as cluster, case when meeting_id % 7 <> 6 then case when meeting_id % 4 = 1 then {_SOURCE} else max_by(speaker_id, (duration, id)) end end as speaker_id, case when meeting_id % 5 = 0 then 'user' else 'auto' end as matched_by from t_prototypes group by meeting_id, channel),
ce as (select meeting_id, channel as cluster, list(s order by pos) as c from (select meeting_id, channel, pos, sum(x) as s from (select meeting_id, channel, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from t_prototypes) group by all) group by meeting_id, channel)"""


def _replaced(spark, d, target):
    p = views.prototypes(spark, d)
    means = v.centroids(p, ["meeting_id", "channel"], "embedding").select("meeting_id", F.col("channel").alias("cluster"), "channel", "centroid")
    now, left = b.replace_speaker(_bindings(p), p, means, _SOURCE, target, _THRESHOLD)
    return now.withColumn("score", F.round("score", 6)), left


def _replaced_sql(target: str) -> str:
    held = f"case when speaker_id = {_SOURCE} and matched_by = 'auto' then {target} else speaker_id end"
    return _BOUND + f""",
mv as (select meeting_id, cluster, {held} as speaker_id, matched_by, case when speaker_id = {_SOURCE} and matched_by = 'auto' then null else 0.5 end as score from bd),
op as (select ce.* from ce join mv using (meeting_id, cluster) where mv.speaker_id is null and matched_by <> 'user' and meeting_id in (select meeting_id from bd where speaker_id = {_SOURCE} and matched_by = 'auto')),
pr as (select *, embedding::double[] as e from t_prototypes where speaker_id <> {_SOURCE}),
sc as (select meeting_id, cluster, speaker_id, coalesce(max(case when channel = cluster then s end), max(s)) as s from (select op.meeting_id, op.cluster, pr.speaker_id, pr.channel, list_dot_product(c, e) / sqrt(list_dot_product(c, c)) / sqrt(list_dot_product(e, e)) as s from op, pr) group by all),
bm as (select * from sc qualify row_number() over (partition by meeting_id, cluster order by s desc, speaker_id) = 1)"""


_NOW = f"select meeting_id, cluster, coalesce(bm.speaker_id, mv.speaker_id)::int as speaker_id, matched_by, case when bm.s is not null then round(bm.s, 6) else mv.score end as score from mv left join (select * from bm where s > {_THRESHOLD}) bm using (meeting_id, cluster)"
register("replace_rematched", lambda spark, d: _replaced(spark, d, None)[0], oracle(_NOW, "t_prototypes", ctes=_replaced_sql("null")))
register("replace_by_other", lambda spark, d: _replaced(spark, d, 5)[0], oracle(_NOW, "t_prototypes", ctes=_replaced_sql("5")))
register("replace_preview", lambda spark, d: b.affected(_bindings(views.prototypes(spark, d)), views.prototypes(spark, d).select("meeting_id", F.col("channel").alias("cluster")), _SOURCE), oracle(f"select count(distinct meeting_id) as n_meetings, count(*) as n_clusters, coalesce(sum(n), 0)::bigint as n_turns from (select * from bd where speaker_id = {_SOURCE} and matched_by = 'auto') left join (select meeting_id, channel as cluster, count(*) as n from t_prototypes group by all) using (meeting_id, cluster)", "t_prototypes", ctes=_BOUND))


def model_filter(spark, d):
    """Prototypes of one model: a third under its older tag, a third without a tag, the others of another model."""
    model = F.when(F.col("id") % 3 == 0, "ecapa-v1").when(F.col("id") % 3 == 1, "resnet-2")
    return b.of_models(views.prototypes(spark, d).withColumn("model", model), "ecapa-512", {"ecapa-v1": "ecapa-512"}).select("id", "speaker_id")


register("model_filter", model_filter, oracle("select id, speaker_id from t_prototypes where id % 3 <> 1", "t_prototypes"))


def enroll_deduped(spark, d):
    """The coherent longest rows of each meeting and channel go to one speaker, repeats of a block of audio become one, and
    every speaker keeps its best 25."""
    p = views.prototypes(spark, d).withColumn("block", F.floor(F.col("duration") / 5)).withColumn("clip", F.when(F.col("id") % 4 == 3, F.col("id")))
    pool = p.withColumn("pool", F.col("meeting_id") * 2 + (F.col("channel") == "mic").cast("int"))
    picked = v.coherent_pick(pool, "pool", "id", "embedding", "duration", 16, 4, -1.0).select("id", (F.col("pool") % 7).cast("int").alias("speaker_id"))
    rows = p.select("id", "speaker_id", "meeting_id", "channel", "block", "duration", "is_verified", "clip")
    return b.enroll(rows, picked, ["meeting_id", "channel", "block"], "clip", 25).select("id", "speaker_id", "duration", "clip")


register("enroll_deduped", enroll_deduped, oracle("""select id, speaker_id, duration, clip from (
  select *, row_number() over w as rn, coalesce(c, first_value(c ignore nulls) over (w rows between unbounded preceding and unbounded following)) as clip from o
  window w as (partition by speaker_id, meeting_id, channel, block order by is_verified desc, duration desc, id)) where rn = 1 qualify row_number() over (partition by speaker_id order by duration desc, id) <= 25""", "t_prototypes", ctes="""n as (select *, row_number() over (partition by meeting_id, channel order by duration desc, id) as k, floor(duration / 5)::bigint as block, case when id % 4 = 3 then id end as c from t_prototypes),
o as (select * exclude (speaker_id), case when k <= 4 then ((meeting_id * 2 + case when channel = 'mic' then 1 else 0 end) % 7)::int else speaker_id end as speaker_id from n)"""))


def tag_rename(spark, d):
    """Every tag asks for a name: its own in lower case, its neighbour's, none, or a region's, which several want."""
    t = views.tags(spark, d).withColumn("tag_id", F.col("tag_id").cast("long"))
    near = t.select((F.col("tag_id") + 1).alias("tag_id"), F.col("name").alias("near"))
    k = F.col("tag_id") % 4
    new = F.when(k == 0, F.concat(F.lit(" "), F.lower("name"))).when(k == 1, F.lower("near")).when(k == 2, F.lit("  ")).otherwise(F.concat(F.lit("Area "), F.col("palette").cast("string"), F.lit(" ")))
    return b.rename_tags(t, t.join(near, "tag_id", "left").select("tag_id", new.alias("new_name")))


register("tag_rename", tag_rename, oracle("select tag_id::bigint as tag_id, case when problem is null then new else name end as name, problem from (select *, case when new = '' then 'empty' when k = 1 or (k = 3 and row_number() over (partition by k, palette order by tag_id) > 1) then 'taken' end as problem from (select *, tag_id % 4 as k, case tag_id % 4 when 0 then lower(name) when 1 then '~' when 2 then '' else 'Area ' || palette end as new from t_tags))", "t_tags"))


def tag_delete(spark, d):
    """Links that are left once every third tag is deleted."""
    t = views.tags(spark, d).withColumn("tag_id", F.col("tag_id").cast("long"))
    tags, links = b.delete_tags(t, views.tag_links(spark, d), t.where("tag_id % 3 = 0").select("tag_id"))
    return tags.join(links.groupBy("tag_id").agg(F.count("*").alias("n")), "tag_id", "left").select("tag_id", "name", F.coalesce("n", F.lit(0)).alias("n_links"))


register("tag_delete", tag_delete, oracle("select tag_id::bigint as tag_id, name, count(l.meeting_id) as n_links from t_tags left join t_tag_links l using (tag_id) where tag_id % 3 <> 0 group by tag_id, name", "t_tags", "t_tag_links"))


def headings(spark, d):
    """The first level-one heading of documents whose second line is made one, and what is left without it."""
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"^([^\n]*\n)([^\n]+)", "$1# $2").alias("text"))
    title, body = x.title_and_body(F.col("text"))
    return t.select("doc_id", title.alias("title"), F.sha2(body, 256).alias("body_sha256"))


_LINE = r"regexp_extract(text, '^[^\n]*\n([^\n]+)', 1)"
_HEADED = rf"(regexp_matches(text, '^[^\n]*\n[^\n]') and not regexp_matches({_LINE}, '^\s*$'))"
register("headings", headings, rf"select doc_id, case when {_HEADED} then nullif(regexp_replace(regexp_replace({_LINE}, '^ +', ''), '[ \t]+$', ''), '') end as title, sha256(case when regexp_matches(text, '^[^\n]*\n[^\n]') then regexp_replace(text, '^([^\n]*\n)[^\n]+\n?', '\1') else text end) as body_sha256 from documents")


def unpacked_spans(spark, d):
    """Turns packed with pauses, the packs cut into thirds, and each third mapped back to the turn at its middle or nearest."""
    t = views.transcripts(spark, d).select("meeting_id", "seq", "start_ms", "end_ms")
    packs = sq.placed(sq.pack_spans(t, ["meeting_id"], ["seq"], 25_000, 300), ["meeting_id"], ["seq"], 300)
    whole = packs.groupBy("meeting_id", "pack").agg(F.max("at_end").alias("len"))
    thirds = whole.select("meeting_id", "pack", F.explode(F.array(*map(F.lit, range(3)))).alias("part"), "len")
    said = thirds.select("meeting_id", "pack", "part", F.expr("len * part div 3").alias("said_start"), F.expr("len * (part + 1) div 3").alias("said_end"))
    return sq.map_back(said, packs, ["meeting_id", "pack"], ["part"]).select("meeting_id", "pack", "part", "seq", "start_ms", "end_ms")


_PACKS = """n as (select meeting_id, seq, start_ms, end_ms, end_ms - start_ms as len, row_number() over (partition by meeting_id order by seq) as i from t_transcripts),
p as (select *, 0 as pack, 0::bigint as a, len as used from n where i = 1 union all select n.*, case when used + 300 + n.len > 25000 then pack + 1 else pack end, case when used + 300 + n.len > 25000 then 0 else used + 300 end, case when used + 300 + n.len > 25000 then n.len else used + 300 + n.len end from p join n on n.meeting_id = p.meeting_id and n.i = p.i + 1),
th as (select meeting_id, pack, part, l * part // 3 as s, l * (part + 1) // 3 as e from (select meeting_id, pack, max(a + len) as l from p group by all), range(3) r(part)),
mb as (select th.*, p.seq, p.start_ms, p.len, p.a, row_number() over (partition by th.meeting_id, th.pack, part order by greatest(2 * p.a - (s + e), (s + e) - 2 * (p.a + p.len) + 1, 0), p.seq) as k from th join p using (meeting_id, pack))"""
register("unpacked_spans", unpacked_spans, oracle("select meeting_id, pack, part::int as part, seq, start_ms + greatest(0, least(len, s - a)) as start_ms, start_ms + greatest(0, least(len, e - a)) as end_ms from mb where k = 1", "t_transcripts", ctes=_PACKS).replace("with t_transcripts", "with recursive t_transcripts", 1))


def _rows(spark, d):
    """Voiceprints with a cluster; every ninth of nobody, every thirteenth without its cluster."""
    k = F.col("id")
    return views.prototypes(spark, d).select("id", F.when(k % 9 != 0, F.col("speaker_id")).alias("speaker_id"), "meeting_id", F.when(k % 13 != 0, F.col("channel")).alias("cluster"), "duration", "is_verified")


def _rejected(spark, d):
    rows = _rows(spark, d)
    gone = rows.where("duration < 6").select("id", (F.col("id") % 2 == 0).alias("permanent"))
    return rows, b.reject(rows, gone), gone


_ROWS = """v as (select id, case when id % 9 <> 0 then speaker_id end as speaker_id, meeting_id, case when id % 13 <> 0 then channel end as cluster, duration, is_verified from t_prototypes),
rj as (select id, case when duration < 6 then null else speaker_id end as speaker_id, meeting_id, cluster, is_verified from v where duration >= 6 or (id % 2 <> 0 and speaker_id is not null and cluster is not null))"""
register("voiceprints_rejected", lambda spark, d: _rejected(spark, d)[1].select("id", "speaker_id", "meeting_id", "cluster", "is_verified"), oracle("select * from rj", "t_prototypes", ctes=_ROWS))
register("rejection_counts", lambda spark, d: b.remaining(*_rejected(spark, d)), oracle("select id, speaker_id, coalesce(n, 0) as n_left from v left join (select speaker_id, count(*) as n from rj where speaker_id is not null group by 1) using (speaker_id) where duration < 6", "t_prototypes", ctes=_ROWS))


def voiceprints_reconfirmed(spark, d):
    """Rows of nobody go to the speaker of their meeting's number; every speaker keeps its thirty longest."""
    rows = _rows(spark, d)
    return b.reconfirm(rows, rows.where("speaker_id is null").select("id", (F.col("meeting_id") % 10).cast("int").alias("new_owner")), 30).select("id", "speaker_id", "is_verified")


register("voiceprints_reconfirmed", voiceprints_reconfirmed, oracle("select id, speaker_id, is_verified from (select id, coalesce(speaker_id, (meeting_id % 10)::int) as speaker_id, duration, is_verified and speaker_id is not null as is_verified from v) qualify row_number() over (partition by speaker_id order by duration desc, id) <= 30", "t_prototypes", ctes=_ROWS))


def voiceprints_verified(spark, d):
    rows = _rows(spark, d)
    speakers = rows.groupBy("speaker_id").agg(F.avg("duration").alias("a")).where("a > 12.5 and speaker_id is not null")
    return b.verify(rows, speakers, rows.where("meeting_id < 10").select("meeting_id")).select("id", "speaker_id", "is_verified")


register("voiceprints_verified", voiceprints_verified, oracle("select id, speaker_id, is_verified or coalesce(speaker_id in (select speaker_id from v where speaker_id is not null group by 1 having avg(duration) > 12.5), false) or (speaker_id is null and meeting_id < 10) as is_verified from v", "t_prototypes", ctes=_ROWS))
register("voiceprints_purged", lambda spark, d: b.purge(_rows(spark, d))[1], oracle("select count(distinct meeting_id) as n_meetings, count(distinct (meeting_id, cluster)) filter (cluster is not null) as n_clusters, count(*) as n_rows from v where speaker_id is null", "t_prototypes", ctes=_ROWS))
