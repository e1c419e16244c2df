"""Queries over voiceprints. The given vectors have no owner structure, so thresholds are below the usual ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes
from ..operators import vectors as v
from ..sources import views
from ..sources.views import oracle
from .registry import register

_COS = "list_dot_product(a, b)"
_D = "embedding::double[]"
_SUMS = f"""u as (select *, list_transform({_D}, lambda x: x / sqrt(list_dot_product({_D}, {_D}))) as unit from t_prototypes),
sums as (select speaker_id, max(n) as n, list(s order by pos) as total from (select speaker_id, pos, sum(x) as s, count(*) as n from (select speaker_id, unnest(unit) as x, generate_subscripts(unit, 1) as pos from u) group by all) group by speaker_id)"""
_OWN = _SUMS + """,
rest as (select u.*, n, total, list_transform(list_zip(total, unit), lambda z: z[1] - z[2]) as others from u join sums using (speaker_id)),
own as (select *, list_dot_product(unit, others) / sqrt(list_dot_product(others, others)) as own from rest where n >= 3)"""

register("centroid", lambda spark, d: v.centroids(views.prototypes(spark, d), ["speaker_id"], "embedding").select("speaker_id", "n", F.posexplode("centroid").alias("pos", "x")).select("speaker_id", "n", "pos", F.round("x", 6).alias("x")), oracle("select speaker_id, n, (pos - 1)::int as pos, round(x, 6) as x from (select speaker_id, n, unnest(total) / n / sqrt(list_dot_product(total, total) / n / n) as x, generate_subscripts(total, 1) as pos from raw)", "t_prototypes", ctes=f"raw as (select speaker_id, max(n) as n, list(s order by pos) as total from (select speaker_id, pos, sum(x) as s, count(*) as n from (select speaker_id, unnest({_D}) as x, generate_subscripts(embedding, 1) as pos from t_prototypes) group by all) group by speaker_id)"))
register("leave_one_out", lambda spark, d: v.leave_one_out(views.prototypes(spark, d), ["speaker_id"], "embedding").select("id", "speaker_id", F.round("own", 6).alias("own")), oracle("select id, speaker_id, round(own, 6) as own from own", "t_prototypes", ctes=_OWN))
register("suspect_prototypes", lambda spark, d: v.suspects(views.prototypes(spark, d), "speaker_id", "id", "embedding", 0.05).select("id", F.round("own", 6).alias("own"), F.round("nearest_other", 6).alias("nearest_other"), "suspect"), oracle("select o.id, round(o.own, 6) as own, round(max(case when s.speaker_id <> o.speaker_id then list_dot_product(o.unit, s.total) / sqrt(list_dot_product(s.total, s.total)) end), 6) as nearest_other, o.own < 0.05 or max(case when s.speaker_id <> o.speaker_id then list_dot_product(o.unit, s.total) / sqrt(list_dot_product(s.total, s.total)) end) > o.own as suspect from own o cross join (select * from sums where n >= 3) s group by o.id, o.own", "t_prototypes", ctes=_OWN))


def cosine_best_match(spark, d):
    """Every row whose id is divisible by 100 against all others."""
    p = views.prototypes(spark, d)
    q = p.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("channel").alias("q_channel"), F.col("embedding").alias("q_vec"))
    return v.best_match(q, p, 0.3).select("q_id", "speaker_id", F.round("score", 6).alias("score"))


register("cosine_best_match", cosine_best_match, oracle("select q_id, speaker_id, round(score, 6) as score from (select q_id, speaker_id, coalesce(max(case when same then c end), max(c)) as score from c group by all) where true qualify row_number() over (partition by q_id order by score desc, speaker_id) = 1 and score > 0.3", "t_prototypes", ctes="n as (select *, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as l from t_prototypes), c as (select q.id as q_id, p.speaker_id, q.channel = p.channel as same, list_dot_product(q.v, p.v) / (q.l * p.l) as c from n q join n p on q.id % 100 = 0 and p.id <> q.id)"))
register("coherent_pick", lambda spark, d: v.coherent_pick(views.prototypes(spark, d), "speaker_id", "id", "embedding", "duration", 16, 8, -0.05).select("speaker_id", "id", "pick"), oracle("select speaker_id, id, row_number() over (partition by speaker_id order by rn) as pick from own qualify pick <= 8", "t_prototypes", ctes="t as (select *, row_number() over (partition by speaker_id order by duration desc, id) as rn from t_prototypes qualify rn <= 16), " + _OWN.replace("from t_prototypes)", "from t)").replace("where n >= 3)", "where n < 3 or list_dot_product(unit, others) / sqrt(list_dot_product(others, others)) >= -0.05)")))
register("reconfirm_similarity", lambda spark, d: (lambda p: p.where("not is_verified").join(v.centroids(p.where("is_verified"), ["speaker_id"], "embedding").where("n >= 2"), "speaker_id").select("id", "speaker_id", F.round(v.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity")))(views.prototypes(spark, d)), oracle("select p.id, p.speaker_id, round(list_dot_product(p.embedding::double[], total) / sqrt(list_dot_product(total, total)) / sqrt(list_dot_product(p.embedding::double[], p.embedding::double[])), 6) as similarity from t_prototypes p join raw using (speaker_id) where not is_verified and n >= 2", "t_prototypes", ctes=f"raw as (select speaker_id, max(n) as n, list(s order by pos) as total from (select speaker_id, pos, sum(x) as s, count(*) as n from (select speaker_id, unnest({_D}) as x, generate_subscripts(embedding, 1) as pos from t_prototypes where is_verified) group by all) group by speaker_id)"))
register("allowlist_filter", lambda spark, d: (lambda p, allow: p.join(allow, ["meeting_id", "speaker_id"], "left_semi").unionByName(p.join(allow.select("meeting_id").distinct(), "meeting_id", "left_anti")).select("id", "meeting_id", "speaker_id"))(views.prototypes(spark, d), views.prototypes(spark, d).where("meeting_id < 10 and duration > 20").select("meeting_id", "speaker_id").distinct()), oracle("select id, meeting_id, speaker_id from t_prototypes where (meeting_id, speaker_id) in (select meeting_id, speaker_id from a) or meeting_id not in (select meeting_id from a)", "t_prototypes", ctes="a as (select distinct meeting_id, speaker_id from t_prototypes where meeting_id < 10 and duration > 20)"))


def replace_speaker(spark, d):
    p = views.prototypes(spark, d).select("id", "speaker_id", "duration")
    moved = p.where("speaker_id = 3").withColumn("speaker_id", F.lit(5))
    return changes.upsert(p, moved, ["id"])


register("replace_speaker", replace_speaker, oracle("select id, case when speaker_id = 3 then 5 else speaker_id end as speaker_id, duration from t_prototypes", "t_prototypes"))
register("level_percent", lambda spark, d: views.prototypes(spark, d).select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (20 * F.log10(F.sqrt(v.dot(F.col("embedding"), F.col("embedding")) / F.size("embedding"))) + 60) / 60)), 6).alias("level"), F.round(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))), 6).alias("peak")), oracle("select id, round(least(1.0, greatest(0.0, (20 * log10(sqrt(list_dot_product(embedding::double[], embedding::double[]) / len(embedding))) + 60) / 60)), 6) as level, round(list_max(list_transform(embedding::double[], lambda x: abs(x))), 6) as peak from t_prototypes", "t_prototypes"))
