"""Who is who and runs of a job, on hand-made rows and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as x
from colloquy.operators import bindings as b
from colloquy.operators import runs

BOUND = "meeting_id long, cluster string, speaker_id int, matched_by string, score double"
PRINTS = "id long, speaker_id int, channel string, embedding array<double>"
CENTRES = "meeting_id long, cluster string, channel string, centroid array<double>"
ROWS = "id long, speaker_id int, meeting_id long, cluster string, duration double, is_verified boolean"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_replaced_speaker_is_looked_at_again(spark):
    bound = spark.createDataFrame([(1, "a", 3, "auto", 0.9), (1, "b", None, "auto", None), (1, "c", 3, "user", 0.8), (1, "d", None, "user", None), (2, "a", None, "auto", None), (2, "b", 4, "auto", 0.7)], BOUND)
    prints = spark.createDataFrame([(1, 3, "mic", [1.0, 0.0]), (2, 4, "mic", [0.8, 0.6]), (3, 5, "system", [0.0, 1.0])], PRINTS)
    centres = spark.createDataFrame([(m, c, "mic", [1.0, 0.0]) for m, c in ((1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a"))], CENTRES)
    now, left = b.replace_speaker(bound, prints, centres, 3, None, 0.5)
    # The user's rows stay, also an empty one; the other meeting was not touched.
    assert rows(now.withColumn("score", F.round("score", 3))) == sorted([(1, "a", 4, "auto", 0.8), (1, "b", 4, "auto", 0.8), (1, "c", 3, "user", 0.8), (1, "d", None, "user", None), (2, "a", None, "auto", None), (2, "b", 4, "auto", 0.7)], key=repr)
    assert [r[0] for r in rows(left.select("id"))] == [2, 3]
    moved, _ = b.replace_speaker(bound, prints, centres, 3, 5, 0.5)
    assert (1, "a", 5, "auto", None) in rows(moved) and (1, "b", 4, "auto", 0.8) in rows(moved.withColumn("score", F.round("score", 3)))
    untouched, gone = b.replace_speaker(bound, prints, centres, 4, None, 0.99)
    assert (2, "b", None, "auto", None) in rows(untouched) and gone.count() == 2
    assert rows(b.affected(bound, bound.select("meeting_id", "cluster"), 3)) == [(1, 1, 1)] and rows(b.affected(bound.where("false"), bound.select("meeting_id", "cluster"), 3)) == [(0, 0, 0)]
    none, _ = b.replace_speaker(bound.where("false"), prints, centres, 3, None, 0.5)
    assert none.count() == 0


def test_single_voiceprints(spark):
    df = spark.createDataFrame([(1, 7, 1, "a", 5.0, True), (2, 7, None, "a", 4.0, False), (3, None, 1, "a", 3.0, False), (4, 7, 1, "b", 2.0, False), (5, 8, 2, "a", 1.0, False)], ROWS)
    gone = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "id long, permanent boolean")
    after = b.reject(df, gone)
    assert rows(after.select("id", "speaker_id")) == [(1, None), (5, 8)]
    assert rows(b.remaining(df, after, gone)) == [(1, 7, 0), (2, 7, 0), (3, None, 0), (4, 7, 0)]
    again = b.reconfirm(df, spark.createDataFrame([(3, 7)], "id long, new_owner int"), 2)
    assert rows(again.select("id", "speaker_id", "is_verified")) == [(1, 7, True), (2, 7, False), (5, 8, False)]
    seen = b.verify(df, df.where("speaker_id = 8").select("speaker_id"), df.where("meeting_id = 1").select("meeting_id"))
    assert [r[0] for r in rows(seen.where("is_verified").select("id"))] == [1, 3, 5]
    left, what = b.purge(df)
    assert left.count() == 4 and rows(what) == [(1, 1, 1)] and b.purge(df.where("false"))[1].collect()[0].n_rows == 0


def test_tags_by_name(spark):
    tags = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "tag_id long, name string")
    asked = spark.createDataFrame([(1, " ONE "), (2, "three"), (3, "New"), (9, "none")], "tag_id long, new_name string")
    assert rows(b.rename_tags(tags, asked)) == [(1, "ONE", None), (2, "Two", "taken"), (3, "New", None)]
    asked = spark.createDataFrame([(1, "same"), (2, "Same"), (3, None)], "tag_id long, new_name string")
    assert rows(b.rename_tags(tags, asked)) == [(1, "same", None), (2, "Two", "taken"), (3, "Three", "empty")]
    assert b.rename_tags(tags, asked.where("false")).count() == 0


def test_runs_end_once(spark):
    old = spark.createDataFrame([("a", "completed", 1, "r1", None, None), ("b", "failed", 1, None, None, "x")], "k string, status string, start_time int, result string, backup string, error string")
    now = runs.start(old, spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "k string, start_time int"), "k")
    assert rows(now) == sorted([("a", "pending", 2, "r1", "r1", None), ("b", "pending", 2, None, None, None), ("c", "pending", 2, None, None, None)], key=repr)
    ends = spark.createDataFrame([("a", 2, "cancelled", None, "stop"), ("b", 1, "completed", "late", None), ("c", 2, "completed", "r2", None)], "k string, start_time int, outcome string, result string, error string")
    done = runs.finish(now, ends, "k")
    assert rows(done) == sorted([("a", "cancelled", 2, "r1", None, "stop"), ("b", "pending", 2, None, None, None), ("c", "completed", 2, "r2", None, None)], key=repr)
    assert rows(runs.finish(done, ends, "k")) == rows(done)
    assert ("b", "failed", 2, None, None, "over") in rows(runs.fail_interrupted(done, "k", "over"))


def test_cached_texts(spark):
    cache = '{"english_cache":{"markdown":%s,"source":{"a":"1"},"output_language":"German"}}'
    cases = [(cache % '"m"', '{"a":"1"}', "French"), (cache % '"m"', '{"a":"2"}', "French"), (cache % '"m"', '{"a":"1"}', "German"), (cache % '"m"', '{"a":"1"}', "English"), (cache % '" "', '{"a":"1"}', "French"), (cache % '"m"', '{"a":"1"}', None), ("{", '{"a":"1"}', "French"), (None, '{"a":"1"}', "French")]
    df = spark.createDataFrame(cases, "r string, s string, l string").coalesce(1)
    assert [r[0] for r in df.select(x.cached_text(F.col("r"), F.col("s"), F.col("l"))).collect()] == ["m"] + [None] * 7
    tokens = spark.createDataFrame([('[{"text":"a","start":0,"end":1}]',), ("[",), (None,), ("{}",)], "t string").coalesce(1)
    assert [len(r[0] or []) for r in tokens.select(x.token_array(F.col("t"))).collect()][:3] == [1, 0, 0]
