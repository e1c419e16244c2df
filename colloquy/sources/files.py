"""Files of speech tools as frames, and back: RTTM and UEM lines, sidecar JSON lines, label exports, CSV scripts.

Line parsers work on a frame of lines, so they are tested without files and run on any number of them; readers only add
``spark.read``.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = "uri string, index long, start double, end double, speaker string, stable boolean, display_name string, matched_by string, match_score double"


def rttm_lines(spans: DataFrame) -> DataFrame:
    """One SPEAKER line for each span (uri, start_ms, end_ms, label), three decimals."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("uri"), F.col("start_ms") / 1000, (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("label"))
    return spans.select(line.alias("value"))


def parse_rttm(lines: DataFrame) -> DataFrame:
    """uri, start_ms, end_ms, label and valid of each line that is not blank: ten fields, SPEAKER, numbers."""
    f = F.split(F.trim("value"), r"\s+")
    ms = lambda k: F.round(F.try_element_at(f, F.lit(k)).try_cast("double") * 1000).cast("long")
    at = lambda k: F.try_element_at(f, F.lit(k))
    rows = lines.where(F.trim("value") != "")
    ok = (F.size(f) == 10) & (at(1) == "SPEAKER") & ms(4).isNotNull() & ms(5).isNotNull()
    return rows.select(at(2).alias("uri"), ms(4).alias("start_ms"), (ms(4) + ms(5)).alias("end_ms"), at(8).alias("label"), F.coalesce(ok, F.lit(False)).alias("valid"))


def parse_uem(lines: DataFrame) -> DataFrame:
    """uri, start_ms, end_ms of lines ``uri 1 start end``."""
    f = F.split(F.trim("value"), r"\s+")
    ms = lambda k: F.round(F.try_element_at(f, F.lit(k)).try_cast("double") * 1000).cast("long")
    return lines.where(F.trim("value") != "").select(F.try_element_at(f, F.lit(1)).alias("uri"), ms(3).alias("start_ms"), ms(4).alias("end_ms"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Valid lines; an invalid one is an error. An empty file is silence."""
    rows = parse_rttm(spark.read.text(path))
    return rows.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.lit("an invalid RTTM line")).cast("boolean"))).where("valid").drop("valid")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def sidecar_lines(emissions: DataFrame) -> DataFrame:
    """One JSON line for each emission."""
    return emissions.select(F.to_json(F.struct(*emissions.columns)).alias("value"))


def parse_sidecar(lines: DataFrame) -> DataFrame:
    """Emissions of JSON lines by a fixed schema; a line that does not parse is an error, header lines go."""
    j = F.from_json("value", SIDECAR, {"mode": "FAILFAST"})
    return lines.where(F.trim("value") != "").select(j.alias("j")).select("j.*").where("`index` is not null")


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """A sidecar whose first line must be a header naming its version."""
    lines = spark.read.text(path)
    head = lines.first()
    if head is None or '"version"' not in head["value"]:
        raise ValueError(f"{path} has no sidecar header")
    return parse_sidecar(lines)


def read_label_export(spark: SparkSession, path: str) -> DataFrame:
    """uri, start, end, label of a label tool's JSON export: the last annotation, regions named ``labels`` only, the
    first label, lower-cased with underscores; empty regions go."""
    schema = "id long, data struct<audio:string>, annotations array<struct<result:array<struct<from_name:string,value:struct<start:double,end:double,labels:array<string>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    last = F.try_element_at("annotations", F.lit(-1))
    r = rows.select(F.regexp_extract("data.audio", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("uri"), F.explode(last["result"]).alias("r")).where("r.from_name = 'labels'")
    return r.select("uri", F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"), F.regexp_replace(F.lower(F.element_at("r.value.labels", 1)), " ", "_").alias("label")).where("end > start")


def explode_speakers(rows: DataFrame) -> DataFrame:
    """Rows (uri, speakers: array of (label, start_ms, end_ms)) to spans; empty ones go."""
    return rows.select("uri", F.inline("speakers")).where("end_ms > start_ms")


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV with a header and a text column; blank texts go."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    if "text" not in df.columns:
        raise ValueError(f"{path} has no text column")
    return df.where(F.trim("text") != "")


def parse_export(lines: DataFrame) -> DataFrame:
    """speaker and text of plain ``Name: words`` lines."""
    return lines.select(F.regexp_extract("value", r"^([^:]{1,40}):\s+(.*)$", 1).alias("speaker"), F.regexp_extract("value", r"^([^:]{1,40}):\s+(.*)$", 2).alias("text")).where("speaker <> ''")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """One table of several sources, with their names; missing columns are null."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def preferred_files(names: DataFrame) -> DataFrame:
    """Of files ``stem_number.ext`` (column name): FLAC if a stem has any, else MP4, by number."""
    n = names.select("name", F.regexp_extract("name", r"^(.*)_(\d+)\.(flac|mp4)$", 1).alias("stem"), F.regexp_extract("name", r"^(.*)_(\d+)\.(flac|mp4)$", 2).try_cast("int").alias("number"), F.regexp_extract("name", r"\.(flac|mp4)$", 1).alias("ext")).where("number is not null")
    best = n.groupBy("stem").agg(F.min("ext").alias("ext"))
    return n.join(best, ["stem", "ext"]).orderBy("stem", "number")


def present_only(lines: DataFrame, durations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SPEAKER lines of recordings (uri, seconds) that are there, and a UEM line over the whole of each recording."""
    f = F.split(F.trim("value"), r"\s+")
    speaker = lines.where(F.try_element_at(f, F.lit(1)) == "SPEAKER").withColumn("uri", F.try_element_at(f, F.lit(2)))
    return speaker.join(durations.select("uri"), "uri", "left_semi"), durations.select("uri", F.format_string("%s 1 0.0 %.3f", "uri", "seconds").alias("value"))


#: Fixed value: how recordings of a meeting corpus are named.
MEETING_NAME = r"^(es\d{4}|ibi?\d{4}|en\d{4}|st\d{4})([a-f])(?=[._])|^(ic\d{3}|is\d{4})(?=[._])"


def meeting_name(file: Column) -> Column:
    """The meeting of a corpus file, series in capitals, or null."""
    part = lambda k: F.regexp_extract(F.lower(file), MEETING_NAME, k)
    return F.nullif(F.concat(F.upper(part(1)), part(2), F.upper(part(3))), F.lit(""))


def report_lines(scores: DataFrame, key: str, baseline: str) -> DataFrame:
    """Rows of a Markdown table (pos, value): header, then a line for each row by key: rate, its parts, baseline, difference.

    ``scores``: key, der, fa, miss, conf and the baseline, in percent; a missing baseline and its difference read n/a.
    """
    head = ["| Dataset | DER % | FA % | Miss % | Conf % | Baseline % | Difference |", "| --- | ---: | ---: | ---: | ---: | ---: | ---: |"]
    lines = scores.sparkSession.createDataFrame([(k - len(head), h) for k, h in enumerate(head)], "pos long, value string")
    base = F.when(F.col(baseline).isNull(), "n/a").otherwise(F.format_string("%.1f", F.col(baseline)))
    delta = F.when(F.col(baseline).isNull(), "n/a").otherwise(F.format_string("%+.2f", F.col("der") - F.col(baseline)))
    cells = [F.format_string("%.2f", c) for c in ("der", "fa", "miss", "conf")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(key).cast("string"), *cells, base, delta), F.lit(" |"))
    return lines.unionByName(scores.select(F.col(key).cast("long").alias("pos"), row.alias("value")))


# -- whole files -------------------------------------------------------------------------------------------------------


def whole_files(spark: SparkSession, path: str, recurse: bool = False) -> DataFrame:
    """path and value (all of its text) of each file that a path or pattern names.

    Spark's scans pass over files of no length; those are taken from the listing that it makes for the scan.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recurse).load(path)
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    names = [(unquote(name),) for name in found.inputFiles()]
    listed = spark.createDataFrame(names, "path string").select(plain.alias("path"))
    read = found.select(plain.alias("path"), F.decode("content", "UTF-8").alias("value"))
    return listed.join(read, "path", "left").select("path", F.coalesce("value", F.lit("")).alias("value"))


def _lines(value: Column) -> Column:
    """The lines of a text with their numbers from 1; blank ones go, but count."""
    each = F.transform(F.split(value, "\r\n|\n|\r"), lambda x, k: F.struct((k + 1).alias("n"), x.alias("line")))
    return F.filter(each, lambda x: F.trim(x["line"]) != "")


def check_rttm(files: DataFrame) -> DataFrame:
    """path, n_turns and valid of each file: ten fields a line that is not blank, SPEAKER, a whole number and two numbers,
    and a line end behind the last. An empty file is silence and valid."""
    number = r"[+-]?(\d+(_?\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?"

    def good(x: Column) -> Column:
        f = F.split(F.trim(x["line"]), r"\s+")
        at = lambda k: F.coalesce(F.get(f, F.lit(k)), F.lit(""))
        named = F.lower(F.regexp_replace(at(3), "^[+-]", "")).isin("nan", "inf", "infinity"), F.lower(F.regexp_replace(at(4), "^[+-]", "")).isin("nan", "inf", "infinity")
        numbers = at(2).rlike(r"^[+-]?\d+(_?\d+)*$") & (at(3).rlike(f"^{number}$") | named[0]) & (at(4).rlike(f"^{number}$") | named[1])
        return (F.size(f) == 10) & (at(0) == "SPEAKER") & numbers

    lines = _lines(F.col("value"))
    ended = (F.col("value") == "") | F.endswith("value", F.lit("\n"))
    return files.select("path", F.size(lines).alias("n_turns"), (ended & F.forall(lines, good)).alias("valid"))


def check_sidecars(files: DataFrame) -> DataFrame:
    """path, value and problem of each file of JSON lines, null where all is well: each line a record, a header among
    them, otherwise emissions. The first bad line counts before a missing header."""
    record = lambda x: F.get_json_object(x["line"], "$.record")
    shape = lambda x: F.try_variant_get(F.try_parse_json(x["line"]), "$", "map<string,variant>")
    lines = _lines(F.col("value"))
    bad = F.get(F.filter(lines, lambda x: shape(x).isNull() | ~F.coalesce(record(x).isin("header", "emission"), F.lit(False))), F.lit(0))
    what = F.when(shape(bad).isNull(), F.concat(F.lit("malformed line "), bad["n"])).otherwise(F.concat(F.lit("unknown record in line "), bad["n"]))
    headed = F.exists(lines, lambda x: record(x) == "header")
    return files.select("path", "value", F.when(bad.isNotNull(), what).when(~headed, F.lit("no header")).alias("problem"))


def read_sidecars(files: DataFrame, strict: bool = True) -> DataFrame:
    """path and the emissions of checked sidecars; a file with a problem is an error, or is left out if not ``strict``."""
    checked = check_sidecars(files)
    sound = F.when(F.col("problem").isNull(), True).when(F.lit(strict), F.raise_error(F.concat("path", F.lit(": "), "problem")).cast("boolean")).otherwise(False)
    lines = checked.where(sound).select("path", F.explode(_lines(F.col("value"))).alias("x")).where(F.get_json_object("x.line", "$.record") == "emission")
    return lines.select("path", F.from_json("x.line", SIDECAR).alias("j")).select("path", "j.*")


def check_label_exports(files: DataFrame) -> DataFrame:
    """uri, start, end, label of whole JSON exports of a label tool: a list of tasks or an object that holds them.

    Of each task with audio the last annotation counts, of that the regions named ``labels`` with a label, the first
    label in lower case with underscores; regions that do not end behind their start go. Broken JSON is an error.
    """
    task = "array<struct<data:struct<audio:string>,annotations:array<struct<result:array<struct<from_name:string,value:struct<start:double,end:double,labels:array<string>>>>>>>>"
    plain = F.trim("value").startswith("[")
    tasks = F.when(plain, F.from_json("value", task, {"mode": "FAILFAST"})).otherwise(F.from_json("value", f"tasks {task}", {"mode": "FAILFAST"})["tasks"])
    rows = files.select(F.explode(tasks).alias("t")).where("t.data.audio <> ''")
    last = F.try_element_at("t.annotations", F.lit(-1))
    uri = F.regexp_extract("t.data.audio", r"([^/]+?)(?:\.[^./]*)?$", 1)
    r = rows.select(uri.alias("uri"), F.explode(last["result"]).alias("r")).where("r.from_name = 'labels' and size(r.value.labels) > 0")
    label = F.regexp_replace(F.lower(F.element_at("r.value.labels", 1)), " ", "_")
    return r.select("uri", F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"), label.alias("label")).where("end > start")


def transcript_sources(files: DataFrame) -> DataFrame:
    """source, start, end, channel, text of whole transcript files, told apart by their names.

    ``transcripts*.json`` (segments with audio_start_time, audio_end_time, source_device; the source is what follows the
    first word, or ``own``), ``asr_*.json`` (segments with start, end, source) and plain exports ``*.txt``: behind the
    line ``Transcript:`` a ``Name: words`` line each, ``Me`` is the microphone. Broken JSON is an error; other files go.
    """
    named = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "value")
    own = "segments array<struct<audio_start_time:double,audio_end_time:double,source_device:string,text:string>>"
    asr = "segments array<struct<start:double,end:double,source:string,text:string>>"
    strict = {"mode": "FAILFAST"}
    columns = ["source", "start", "end", "channel", "text"]
    a = named.where(F.col("name").rlike(r"^transcripts.*\.json$")).select("name", F.explode(F.from_json("value", own, strict)["segments"]).alias("s"))
    a = a.select(F.coalesce(F.nullif(F.regexp_extract("name", r"^transcripts_?(.*)\.json$", 1), F.lit("")), F.lit("own")).alias("source"), F.col("s.audio_start_time").alias("start"), F.col("s.audio_end_time").alias("end"), F.col("s.source_device").alias("channel"), "s.text")
    b = named.where(F.col("name").rlike(r"^asr_.*\.json$")).select(F.regexp_extract("name", r"^asr_(.*)\.json$", 1).alias("source"), F.explode(F.from_json("value", asr, strict)["segments"]).alias("s"))
    b = b.select("source", "s.start", "s.end", F.col("s.source").alias("channel"), "s.text")
    body = F.regexp_extract("value", r"(?s)Transcript:(.*)", 1)
    c = named.where(F.col("name").rlike(r"\.txt$")).select(F.regexp_extract("name", r"^(.*)\.txt$", 1).alias("source"), F.explode(F.split(body, "\r\n|\n|\r")).alias("line")).where(F.contains("line", F.lit(":")))
    me = F.trim(F.substring_index("line", ":", 1)) == "Me"
    none = F.lit(None).cast("double")
    c = c.select("source", none.alias("start"), none.alias("end"), F.when(me, "Microphone").otherwise("System").alias("channel"), F.regexp_extract("line", r"^[^:]*:(.*)$", 1).alias("text"))
    return a.select(*columns).unionByName(b.select(*columns)).unionByName(c.select(*columns))


def timing_lines(runs: DataFrame) -> DataFrame:
    """One JSON line for each run (uri, audio_secs, wall_secs, finalize_secs) with its real-time factor (0 without audio)."""
    factor = F.when(F.col("audio_secs") > 0, F.col("wall_secs") / F.col("audio_secs")).otherwise(F.lit(0.0))
    fields = ["uri", F.lit("fast").alias("mode"), "audio_secs", "wall_secs", factor.alias("real_time_factor"), "finalize_secs"]
    return runs.select(F.to_json(F.struct(*fields)).alias("value"))


def parse_timing(lines: DataFrame) -> DataFrame:
    """The runs of timing lines; a line that does not parse is an error."""
    schema = "uri string, mode string, audio_secs double, wall_secs double, real_time_factor double, finalize_secs double"
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def score_lines(scores: DataFrame) -> DataFrame:
    """One JSON object a row of scores, nulls written out: the score file of a data set."""
    return scores.select(F.to_json(F.struct(*scores.columns), {"ignoreNullFields": "false"}).alias("value"))


def scored_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines of recordings (known: uri) that are there: SPEAKER with eight fields at least, as corpora write them."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.size(f) >= 8) & (F.get(f, F.lit(0)) == "SPEAKER")).withColumn("uri", F.get(f, F.lit(1)))
    return rows.join(known.select("uri").distinct(), "uri", "left_semi").select("uri", "value")
