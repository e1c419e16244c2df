"""Changes of who is who: speakers replaced everywhere with a second look at what they leave, enrolment, tags by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import changes, relational
from . import vectors as v


def of_models(prototypes: DataFrame, model: str, aliases: dict[str, str]) -> DataFrame:
    """Prototypes of one embedding model; ``aliases`` maps older tags to the models they mean, null is the first of them."""
    old = [F.lit(x) for pair in aliases.items() for x in pair]
    tag = F.coalesce("model", F.lit(next(iter(aliases), model)))
    named = F.coalesce(F.create_map(*old)[tag], tag) if old else tag
    return prototypes.where(named == model)


def affected(bindings: DataFrame, turns: DataFrame, source) -> DataFrame:
    """One row: meetings, clusters and turns (meeting_id, cluster) that replacing a speaker would touch: automatic bindings."""
    hit = bindings.where((F.col("speaker_id") == source) & (F.col("matched_by") == "auto")).select("meeting_id", "cluster")
    said = turns.join(hit, ["meeting_id", "cluster"], "left_semi").agg(F.count("*").alias("n_turns"))
    return hit.agg(F.countDistinct("meeting_id").alias("n_meetings"), F.count("*").alias("n_clusters")).crossJoin(said)  # two single rows


def replace_speaker(bindings: DataFrame, prototypes: DataFrame, centroids: DataFrame, source, target, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The next bindings (meeting_id, cluster, speaker_id, matched_by, score) and prototypes once ``source`` is gone.

    Its automatic bindings go to ``target`` (None: to nobody) without a score, a user's stay; its prototypes are deleted.
    Then the meetings that were touched are matched again: clusters of ``centroids`` (meeting_id, cluster, channel,
    centroid) which a user did not bind and nobody holds take the best speaker of the prototypes that are left. Where no
    binding was touched, only the prototypes go.
    """
    mine = (F.col("speaker_id") == source) & (F.col("matched_by") == "auto")
    touched = bindings.where(mine).select("meeting_id").distinct()
    held = F.lit(target).cast(dict(bindings.dtypes)["speaker_id"])
    moved = bindings.withColumns({"score": F.when(~F.coalesce(mine, F.lit(False)), F.col("score")), "speaker_id": F.when(F.coalesce(mine, F.lit(False)), held).otherwise(F.col("speaker_id"))})
    left = prototypes.where(~F.coalesce(F.col("speaker_id") == source, F.lit(False)))
    bound = moved.where("speaker_id is not null or matched_by = 'user'").select("meeting_id", "cluster")
    open_ = centroids.join(touched, "meeting_id", "left_semi").join(bound, ["meeting_id", "cluster"], "left_anti")
    asked = open_.withColumn("q_id", F.concat_ws("/", F.col("meeting_id").cast("string"), "cluster"))
    known = left.where("speaker_id is not null").select("speaker_id", "channel", "embedding")
    found = v.best_match(asked.select("q_id", F.col("channel").alias("q_channel"), F.col("centroid").alias("q_vec")), known, threshold)
    fresh = asked.join(found, "q_id").select("meeting_id", "cluster", "speaker_id", F.lit("auto").alias("matched_by"), "score")
    return changes.upsert(moved, fresh.select(*moved.columns), ["meeting_id", "cluster"]), left


def enroll(prototypes: DataFrame, picked: DataFrame, block: list, payload: str, most: int) -> DataFrame:
    """Prototypes after ``picked`` (id, speaker_id) went to their speakers: of rows of one speaker that ``block`` columns
    call the same only the best stays, verified first, then the longest (it takes ``payload`` of the others where it has
    none), and of these at most ``most`` a speaker, the longest."""
    now = changes.patch(prototypes, picked, ["id"], "speaker_id")
    owned = now.where("speaker_id is not null")
    one = relational.dedupe_with_donor(owned, ["speaker_id", *block], [F.desc("is_verified"), F.desc("duration"), "id"], payload)
    best = relational.keep_best(one.select(*now.columns), ["speaker_id"], [F.desc("duration"), "id"], most)
    return best.unionByName(now.where("speaker_id is null"))


def rename_tags(tags: DataFrame, asked: DataFrame) -> DataFrame:
    """tag_id, name, problem of every tag that ``asked`` (tag_id, new_name) names: the name trimmed, or the old one with
    the reason (empty, or taken by another tag in any case). Of several that ask for one name the smallest id gets it;
    a tag's own name in another case is free."""
    trimmed = F.coalesce(F.trim("new_name"), F.lit(""))
    a = asked.join(tags.select("tag_id", "name"), "tag_id").select("tag_id", "name", trimmed.alias("new"), F.lower(trimmed).alias("key"))
    first = a.groupBy("key").agg(F.min("tag_id").alias("first"))
    owner = tags.select(F.lower("name").alias("key"), F.col("tag_id").alias("owner"))
    j = a.join(owner, "key", "left").join(first, "key")
    taken = (F.col("owner").isNotNull() & (F.col("owner") != F.col("tag_id"))) | (F.col("owner").isNull() & (F.col("first") != F.col("tag_id")))
    problem = F.when(F.col("new") == "", "empty").when(taken, "taken")
    return j.select("tag_id", F.when(problem.isNull(), F.col("new")).otherwise(F.col("name")).alias("name"), problem.alias("problem"))


def delete_tags(tags: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and links (tag_id) without those of ``gone`` (tag_id)."""
    left = changes.cascade_delete({"tags": tags, "links": links}, gone, "tag_id")
    return left["tags"], left["links"]


# -- single voiceprints: rows (id, speaker_id, meeting_id, cluster, is_verified, ...) to the rows after a change ----------


def reject(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """After rejecting ``gone`` (id, permanent): a speaker's row with a meeting and cluster becomes one that nobody owns; it
    goes if that is asked for, if nobody owns it already, or if it does not say where it comes from."""
    j = rows.join(gone.select("id", "permanent"), "id", "left")
    named = F.col("permanent").isNotNull()
    kept = ~F.col("permanent") & F.col("speaker_id").isNotNull() & F.col("meeting_id").isNotNull() & F.col("cluster").isNotNull()
    owner = F.when(named, F.lit(None)).otherwise(F.col("speaker_id"))
    return j.where(~named | kept).withColumn("speaker_id", owner).select(*rows.columns)


def remaining(rows: DataFrame, after: DataFrame, gone: DataFrame) -> DataFrame:
    """id, speaker_id and how many rows its owner has left (0 where nobody owned it) for each rejected row."""
    owner = rows.join(gone.select("id"), "id").select("id", "speaker_id")
    left = after.where("speaker_id is not null").groupBy("speaker_id").agg(F.count("*").alias("n"))
    return owner.join(left, "speaker_id", "left").select("id", "speaker_id", F.coalesce("n", F.lit(0)).alias("n_left"))


def reconfirm(rows: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """After giving rows (asked: id, new_owner) to a speaker, unverified; every speaker keeps its ``most`` longest."""
    j = rows.join(asked.select("id", "new_owner"), "id", "left")
    now = j.withColumns({"speaker_id": F.coalesce("new_owner", "speaker_id"), "is_verified": F.when(F.col("new_owner").isNull(), F.col("is_verified")).otherwise(False)}).select(*rows.columns)
    best = relational.keep_best(now.where("speaker_id is not null"), ["speaker_id"], [F.desc("duration"), "id"], most)
    return best.select(*rows.columns).unionByName(now.where("speaker_id is null"))


def verify(rows: DataFrame, speakers: DataFrame, meetings: DataFrame) -> DataFrame:
    """After verifying all rows of speakers (speaker_id), and of meetings (meeting_id) those that nobody owns."""
    s = speakers.select("speaker_id", F.lit(True).alias("_s")).distinct()
    m = meetings.select("meeting_id", F.lit(True).alias("_m")).distinct()
    j = rows.join(s, "speaker_id", "left").join(m, "meeting_id", "left")
    hit = F.coalesce("_s", F.lit(False)) | (F.coalesce("_m", F.lit(False)) & F.col("speaker_id").isNull())
    return j.withColumn("is_verified", F.col("is_verified") | hit).select(*rows.columns)


def purge(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the rows that nobody owns, and one row of what went: meetings, clusters and rows."""
    gone = rows.where("speaker_id is null")
    return rows.where("speaker_id is not null"), gone.agg(F.countDistinct("meeting_id").alias("n_meetings"), F.countDistinct("meeting_id", "cluster").alias("n_clusters"), F.count("*").alias("n_rows"))
