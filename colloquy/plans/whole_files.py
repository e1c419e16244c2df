"""Queries over files that are written from the tables and read back whole, broken ones included."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..sources import files, views
from ..sources.views import oracle
from ..streaming import runner
from .evaluation import _DER
from .registry import register


def _written(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, value, ended) as one text file a key and read back whole; where ``ended`` is false the last character,
    which has to be >, is the end of the file."""
    spark = rows.sparkSession
    at = f"{runner.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    one = rows.repartition(key).sortWithinPartitions(key)
    one.where("ended").select(key, "value").write.partitionBy(key).text(f"{at}/ended")
    one.where("not ended").select(key, F.regexp_replace("value", ">$", "").alias("value")).write.partitionBy(key).option("lineSep", ">").text(f"{at}/cut")
    return files.whole_files(spark, f"{at}/*/{key}=*/part-*").withColumn(key, F.regexp_extract("path", rf"/{key}=([^/]*)/", 1).cast("long"))


def rttm_files(spark, d):
    """RTTM files of all recordings: every fifth without its last line end, every seventh with a word for a number, every
    eleventh with a line of nine fields."""
    s = views.spans(spark, d).withColumn("uri", F.concat(F.lit("meeting-"), F.col("meeting_id").cast("string")))
    k = F.col("meeting_id")
    text = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("uri"), F.col("start_ms") / 1000, (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("label"))
    whole = s.withColumn("value", text).groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]), "\n").alias("value"))
    broken = F.when(k % 7 == 0, F.regexp_replace("value", "^SPEAKER (\\S+) 1 ", "SPEAKER $1 one ")).when(k % 11 == 0, F.regexp_replace("value", "^SPEAKER ", "")).otherwise(F.col("value"))
    read = _written(whole.select("meeting_id", broken.alias("value"), (k % 5 != 0).alias("ended")), "meeting_id")
    return read.select("meeting_id", "path", "value").transform(lambda f: files.check_rttm(f).join(f.select("path", "meeting_id"), "path")).select("meeting_id", "n_turns", "valid")


register("rttm_files", rttm_files, oracle("select meeting_id, count(*)::int as n_turns, meeting_id % 5 <> 0 and meeting_id % 7 <> 0 and meeting_id % 11 <> 0 as valid from t_spans group by meeting_id", "t_spans"))


def _sidecars(spark, d):
    """Sidecars of all recordings: some headless, some with a record of another kind, some with half a line."""
    e = views.emissions(spark, d)
    k = F.col("meeting_id")
    line = F.to_json(F.struct(F.lit("emission").alias("record"), F.col("idx").alias("index"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("label").alias("speaker"), "stable"))
    body = e.withColumn("line", line).groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]).alias("lines"))
    head = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit('{"record":"header","version":1}'), F.lit(" ")))
    more = F.when(k % 10 == 0, F.array(F.lit('{"record":"note","index":1}'))).when(k % 14 == 0, F.array(F.lit('{"record":"emission","ind'))).otherwise(F.array().cast("array<string>"))
    return _written(body.select("meeting_id", F.array_join(F.concat(head, "lines", more), "\n").alias("value"), F.lit(True).alias("ended")), "meeting_id")


def sidecar_files(spark, d):
    read = _sidecars(spark, d)
    return files.check_sidecars(read).join(read.select("path", "meeting_id"), "path").select("meeting_id", "problem")


_SIDECAR = "case when meeting_id % 10 = 0 then 'unknown record in line ' || (count(*) + 1 + case when meeting_id % 6 = 0 then 0 else 2 end) when meeting_id % 14 = 0 then 'malformed line ' || (count(*) + 1 + case when meeting_id % 6 = 0 then 0 else 2 end) when meeting_id % 6 = 0 then 'no header' end"
register("sidecar_files", sidecar_files, oracle(f"select meeting_id, {_SIDECAR} as problem from t_emissions group by meeting_id", "t_emissions"))


def sidecar_emissions(spark, d):
    read = files.read_sidecars(_sidecars(spark, d), strict=False)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return read.select(F.regexp_extract("path", "meeting_id=([0-9]+)/", 1).cast("long").alias("meeting_id"), F.col("index").alias("idx"), ms("start"), ms("end"), "speaker", "stable")


register("sidecar_emissions", sidecar_emissions, oracle("select meeting_id, idx, start_ms, end_ms, label as speaker, stable from t_emissions where meeting_id % 10 <> 0 and meeting_id % 14 <> 0 and meeting_id % 6 <> 0", "t_emissions"))


def label_exports(spark, d):
    """Exports of a label tool, one task a recording: an earlier annotation, regions of another name, without labels and
    empty ones are left out."""
    s = views.spans(spark, d)
    k = F.col("event_id")
    value = F.struct((F.col("start_ms") / 1000).alias("start"), (F.when(k % 13 == 0, F.col("start_ms")).otherwise(F.col("end_ms")) / 1000).alias("end"), F.when(k % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Kind "), F.initcap("label")), F.lit("second"))).alias("labels"))
    region = F.struct(F.when(k % 9 == 0, "notes").otherwise("labels").alias("from_name"), value.alias("value"))
    tasks = s.groupBy("meeting_id").agg(F.collect_list(region).alias("result"))
    first = F.struct(F.slice("result", 1, 1).alias("result"))
    audio = F.when(F.col("meeting_id") % 8 == 0, F.lit(None)).otherwise(F.format_string("audio/meeting-%d.v1.wav", "meeting_id"))
    task = F.array(F.struct(F.struct(audio.alias("audio")).alias("data"), F.array(first, F.struct("result")).alias("annotations")))
    text = F.when(F.col("meeting_id") % 2 == 0, F.to_json(task)).otherwise(F.to_json(F.struct(task.alias("tasks"))))
    read = files.check_label_exports(_written(tasks.select("meeting_id", text.alias("value"), F.lit(True).alias("ended")), "meeting_id"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return read.select("uri", ms("start"), ms("end"), "label")


register("label_exports", label_exports, oracle("select 'meeting-' || meeting_id || '.v1' as uri, start_ms, end_ms, 'kind_' || label as label from t_spans where event_id % 13 <> 0 and event_id % 17 <> 0 and event_id % 9 <> 0 and end_ms > start_ms and meeting_id % 8 <> 0", "t_spans"))


def transcript_files(spark, d):
    """Every conversation as three files: own segments, another recognizer's, and a plain export; read back by their names."""
    t = views.transcripts(spark, d).withColumn("text", F.trim(F.regexp_replace("text", "\\s+", " ")))
    k, sec = F.col("meeting_id"), lambda c: (F.col(c) / 1000)
    device = F.when(F.col("speaker") == "user", "Microphone").otherwise("System")
    one = lambda *fields: F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("s")))), lambda x: x["s"])
    own = t.groupBy("meeting_id").agg(F.to_json(F.struct(one(sec("start_ms").alias("audio_start_time"), sec("end_ms").alias("audio_end_time"), device.alias("source_device"), "text").alias("segments"))).alias("value"))
    asr = t.groupBy("meeting_id").agg(F.to_json(F.struct(one(sec("start_ms").alias("start"), sec("end_ms").alias("end"), device.alias("source"), F.translate("text", "aeiou", "AEIOU").alias("text")).alias("segments"))).alias("value"))
    line = F.concat(F.when(F.col("speaker") == "user", "Me").otherwise("Them"), F.lit(":"), F.col("text"))
    txt = t.groupBy("meeting_id").agg(F.concat(F.lit("Notes: none\nTranscript:\n"), F.array_join(one(line.alias("l"))["l"], "\n")).alias("value"))
    name = lambda prefix, end: F.concat(F.lit(f"/{prefix}"), k.cast("string"), F.lit(end))
    written = [_written(f.select("meeting_id", "value", F.lit(True).alias("ended")), "meeting_id").select(name(p, e).alias("path"), "value") for f, p, e in ((own, "transcripts_", ".json"), (asr, "asr_r", ".json"), (txt, "export", ".txt"))]
    read = files.transcript_sources(written[0].unionByName(written[1]).unionByName(written[2]))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return read.select("source", ms("start"), ms("end"), "channel", F.sha2("text", 256).alias("text_sha256"))


_SAID = "tt as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as said, case when speaker = 'user' then 'Microphone' else 'System' end as device from t_transcripts)"
register("transcript_files", transcript_files, oracle("select meeting_id::varchar as source, start_ms, end_ms, device as channel, sha256(said) as text_sha256 from tt union all select 'r' || meeting_id, start_ms, end_ms, device, sha256(translate(said, 'aeiou', 'AEIOU')) from tt union all select 'export' || meeting_id, null, null, device, sha256(said) from tt", "t_transcripts", ctes=_SAID))


def _lines_back(lines: DataFrame) -> DataFrame:
    """Lines written as text and read again."""
    at = f"{runner.shared_folder(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    files.write_lines(lines, at)
    return lines.sparkSession.read.text(at)


def timing_files(spark, d):
    """Timing files of all recordings, written and read back."""
    t = views.transcripts(spark, d).groupBy("meeting_id").agg((F.max("end_ms") / 1000).alias("audio_secs"), (F.count("*") * 0.5).alias("wall_secs"), (F.sum("seq") * 0.25).alias("finalize_secs"))
    rows = t.select(F.concat(F.lit("meeting-"), F.col("meeting_id").cast("string")).alias("uri"), F.when(F.col("meeting_id") % 10 != 0, F.col("audio_secs")).otherwise(0.0).alias("audio_secs"), "wall_secs", "finalize_secs")
    return files.parse_timing(_lines_back(files.timing_lines(rows))).withColumn("real_time_factor", F.round("real_time_factor", 9))


register("timing_files", timing_files, oracle("select uri, 'fast' as mode, a as audio_secs, w as wall_secs, round(case when a > 0 then w / a else 0 end, 9) as real_time_factor, f as finalize_secs from (select 'meeting-' || meeting_id as uri, case when meeting_id % 10 <> 0 then max(end_ms) / 1000 else 0 end::double as a, (count(*) * 0.5)::double as w, (sum(seq) * 0.25)::double as f from t_transcripts group by meeting_id)", "t_transcripts"))


def score_files(spark, d):
    """Score files of all recordings, written and read back: rates in percent and the baseline where there is one."""
    c = m.error_components(views.reference(spark, d), views.spans(spark, d), ["meeting_id"])
    share = lambda part: (part * 100 / F.col("total"))
    s = c.select("meeting_id", share(F.col("miss") + F.col("false_alarm") + F.col("confusion")).alias("der"), share(F.col("false_alarm")).alias("fa"), share(F.col("miss")).alias("missed"), share(F.col("confusion")).alias("conf"), F.when(F.col("meeting_id") % 3 != 0, F.lit(25.3)).alias("baseline_der"))
    back = _lines_back(files.score_lines(s)).select(F.from_json("value", "meeting_id long, der double, fa double, missed double, conf double, baseline_der double", {"mode": "FAILFAST"}).alias("j"), F.contains("value", F.lit('"baseline_der":null')).alias("no_baseline"))
    return back.select("j.meeting_id", *[F.round(f"j.{x}", 6).alias(x) for x in ("der", "fa", "missed", "conf")], "j.baseline_der", "no_baseline")


register("score_files", score_files, oracle("select meeting_id, round((miss + false_alarm + confusion) * 100 / total, 6) as der, round(false_alarm * 100 / total, 6) as fa, round(miss * 100 / total, 6) as missed, round(confusion * 100 / total, 6) as conf, case when meeting_id % 3 <> 0 then 25.3 end::double as baseline_der, meeting_id % 3 = 0 as no_baseline from der", "t_spans", "t_reference", ctes=_DER))


def corpus_lines(spark, d):
    """Lines of a corpus of which some are of another kind or too short, for the recordings that were transcribed."""
    s = views.spans(spark, d).withColumn("uri", F.concat(F.lit("meeting-"), F.col("meeting_id").cast("string")))
    k = F.col("event_id")
    line = F.format_string("%s %s 1 %.3f %.3f <NA> <NA>%s", F.when(k % 7 == 0, "SPKR-INFO").otherwise("SPEAKER"), "uri", F.col("start_ms") / 1000, (F.col("end_ms") - F.col("start_ms")) / 1000, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" "), "label")))
    known = views.transcripts(spark, d).where("seq > 2").select(F.concat(F.lit("meeting-"), F.col("meeting_id").cast("string")).alias("uri"))
    return files.scored_lines(_lines_back(s.select(line.alias("value"))), known).groupBy("uri").agg(F.count("*").alias("n_lines"))


register("corpus_lines", corpus_lines, oracle("select 'meeting-' || meeting_id as uri, count(*) as n_lines from t_spans where event_id % 7 <> 0 and event_id % 5 <> 0 and meeting_id in (select meeting_id from t_transcripts where seq > 2) group by meeting_id", "t_spans", "t_transcripts"))
