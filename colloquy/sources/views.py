"""Adapter views: the given tables in the shapes of a meeting store, once as DataFrames and once as SQL.

Times are integer milliseconds, so that both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

WORD = r"[^ \t\r\n\f\x0B]+"


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Turns with estimated times: 0.4 s a word, half a second at least, one after the other."""
    t = table(spark, d, "conversations")
    dur = F.greatest(F.lit(400) * F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)), F.lit(500)).cast("long")
    t = t.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text", dur.alias("dur_ms"))
    before = F.sum("dur_ms").over(Window.partitionBy("meeting_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("start_ms", F.coalesce(before, F.lit(0)))
    return t.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Labelled spans: one for each event, as many minutes long as its value."""
    e = table(spark, d, "events")
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    length = F.round(F.col("value") * 60000).cast("long")
    return e.select((F.col("user_id") % 100).alias("meeting_id"), "event_id", F.col("event_type").alias("label"), start.alias("start_ms"), (start + length).alias("end_ms"))


def emissions(spark: SparkSession, d: str) -> DataFrame:
    """Spans as a live stream: numbered by start in a meeting, every fifth event unstable."""
    number = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_ms", "event_id")).cast("long")
    return spans(spark, d).withColumn("idx", number).withColumn("stable", F.col("event_id") % 5 != 0)


def reference(spark: SparkSession, d: str) -> DataFrame:
    """The reference side: spans half a minute later, with purchase and click exchanged."""
    label = F.when(F.col("label") == "click", "purchase").when(F.col("label") == "purchase", "click").otherwise(F.col("label"))
    return spans(spark, d).select("meeting_id", "event_id", label.alias("label"), (F.col("start_ms") + 30000).alias("start_ms"), (F.col("end_ms") + 30000).alias("end_ms"))


def prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Voiceprints: vectors with an owner, a channel, a duration and the meeting they come from."""
    e = table(spark, d, "embeddings")
    v = F.col("vec_id")
    return e.select(v.alias("id"), F.col("label").alias("speaker_id"), F.when(v % 2 == 0, "mic").otherwise("system").alias("channel"), ((v * 37 % 250) / 10).alias("duration"), (v % 20).alias("meeting_id"), (v % 3 == 0).alias("is_verified"), "embedding")


def meetings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("meeting_id"), F.concat(F.lit("Meeting "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("title"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("started_at"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner_id"), F.col("o_totalprice").alias("price"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("palette"))


def tag_links(spark: SparkSession, d: str) -> DataFrame:
    """Every meeting has the tags of its owner's nation and of the nation of a supplier-like rotation."""
    o, c = meetings(spark, d), table(spark, d, "customer")
    j = o.join(c, o.owner_id == c.c_custkey).select("meeting_id", F.col("c_nationkey").cast("long").alias("tag_id"))
    return j.unionByName(j.select("meeting_id", F.pmod(F.col("tag_id") + F.col("meeting_id"), F.lit(20)).alias("tag_id"))).distinct()


SQL = {
    "t_transcripts": """select meeting_id, seq, speaker, text, dur_ms, coalesce(sum(dur_ms) over w, 0)::bigint as start_ms, (coalesce(sum(dur_ms) over w, 0) + dur_ms)::bigint as end_ms
  from (select conv_id as meeting_id, turn as seq, role as speaker, text, greatest(400 * coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0B]+')), 0), 500)::bigint as dur_ms from conversations)
  window w as (partition by meeting_id order by seq rows between unbounded preceding and 1 preceding)""",
    "t_spans": """select user_id % 100 as meeting_id, event_id, event_type as label, epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + round(value * 60000)::bigint as end_ms from events""",
    "t_emissions": """select *, row_number() over (partition by meeting_id order by start_ms, event_id) as idx, event_id % 5 <> 0 as stable from t_spans""",
    "t_reference": """select meeting_id, event_id, case label when 'click' then 'purchase' when 'purchase' then 'click' else label end as label, start_ms + 30000 as start_ms, end_ms + 30000 as end_ms from t_spans""",
    "t_prototypes": """select vec_id as id, label as speaker_id, case when vec_id % 2 = 0 then 'mic' else 'system' end as channel, (vec_id * 37 % 250) / 10 as duration, vec_id % 20 as meeting_id, vec_id % 3 = 0 as is_verified, embedding from embeddings""",
    "t_meetings": """select o_orderkey as meeting_id, 'Meeting ' || o_orderkey || ' ' || o_orderpriority as title, o_orderdate as created_at, case when o_orderstatus <> 'P' then o_orderdate end as started_at, o_orderstatus as status, o_custkey as owner_id, o_totalprice as price from orders""",
    "t_tags": """select n_nationkey as tag_id, n_name as name, n_regionkey as palette from nation""",
    "t_tag_links": """with j as (select meeting_id, c_nationkey::bigint as tag_id from t_meetings join customer on owner_id = c_custkey) select * from j union select meeting_id, (tag_id + meeting_id) % 20 from j""",
}
_NEEDS = {"t_emissions": ["t_spans"], "t_reference": ["t_spans"], "t_tag_links": ["t_meetings"]}


def oracle(select: str, *views: str, ctes: str = "") -> str:
    """DuckDB SQL of a final select over named views and further common table expressions."""
    names: list[str] = []
    for v in views:
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    parts = [f"{n} as ({SQL[n]})" for n in names] + ([ctes.strip()] if ctes.strip() else [])
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + select
