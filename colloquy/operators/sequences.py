"""Operators whose steps depend on each other inside a small group: one pandas call a group, Spark deals the groups.

A group is one turn's tokens, one meeting's labels or one meeting and channel of vectors.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_blocks(tokens: list[tuple[str, int, int, str | None]], least: int = 2) -> list[dict]:
    """Blocks of (text, start, end, speaker) tokens: a change needs ``least`` tokens of the new speaker in a row, a token
    without a speaker never splits, tokens before the first speaker are dropped, and blocks meet without gaps."""
    out: list[dict] = []
    k = 0
    while k < len(tokens):
        text, start, end, who = tokens[k]
        if who is not None and (not out or who != out[-1]["speaker"]):
            ahead = [t[3] for t in tokens[k : k + least]]
            if not out or ahead == [who] * least:
                if out:
                    out[-1]["end"] = start
                out.append({"speaker": who, "start": start, "end": end, "words": [text]})
                k += 1
                continue
        if out:
            out[-1]["words"].append(text)
            out[-1]["end"] = max(out[-1]["end"], end)
        k += 1
    return [{"speaker": b["speaker"], "start": b["start"], "end": b["end"], "text": " ".join(b["words"])} for b in out]


def split_rows(tokens: DataFrame, row: list[str], least: int = 2) -> DataFrame:
    """Rows (row keys, pos, text, start_ms, end_ms, speaker) of tokens to rows of blocks: block 0 is the row itself,
    block n is its n-th split.

    As ``token_blocks``, by windows: the speaker in force is that of the last place where ``least`` tokens in a row, or
    the first token with a speaker at all, named one; a block begins where it changes.
    """
    w = Window.partitionBy(*row).orderBy("pos")
    so_far = F.count("speaker").over(w.rowsBetween(Window.unboundedPreceding, 0))
    sure = reduce(lambda a, k: a & F.coalesce(F.lead("speaker", k).over(w) == F.col("speaker"), F.lit(False)), range(1, least), F.col("speaker").isNotNull())
    t = tokens.withColumn("_named", F.when(sure | (F.col("speaker").isNotNull() & (so_far == 1)), F.col("speaker")))
    before = F.last("_named", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_new", (F.col("_named").isNotNull() & ~F.col("_named").eqNullSafe(before)).cast("int"))
    t = t.withColumn("block", (F.sum("_new").over(w) - 1).cast("int")).where("block >= 0")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    blocks = t.groupBy(*row, "block").agg(F.min_by("speaker", "pos").alias("speaker"), F.min_by("start_ms", "pos").alias("start_ms"), F.max("end_ms").alias("_end"), words.alias("text"))
    follows = F.lead("start_ms").over(Window.partitionBy(*row).orderBy("block"))
    return blocks.withColumn("end_ms", F.coalesce(follows, "_end")).select(*row, "block", "speaker", "start_ms", "end_ms", "text")


def expand_rows(blocks: DataFrame, row: str, sequence: str) -> DataFrame:
    """Derived ids of split rows: block 0 keeps its row's own, block n is ``{id}_split{n}`` behind it in the sequence."""
    first = F.col("block") == 0
    ident = F.when(first, F.col(row)).otherwise(F.concat(F.col(row), F.lit("_split"), F.col("block").cast("string")))
    place = F.when(first, F.col(sequence)).otherwise(F.col(sequence) + F.col("block") * 10_000 + 1000)
    return blocks.withColumn(row, ident).withColumn(sequence, place)


def greedy_matches(shared: DataFrame, keys: list[str], left: str, right: str, weight: str) -> DataFrame:
    """One-to-one pairs by falling weight (ties by ids); left labels without one come with a null."""
    types = dict(shared.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, left, right))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got: dict = {}
        used: set = set()
        for r in pdf.sort_values([weight, left, right], ascending=[False, True, True]).itertuples(index=False):
            a, b = getattr(r, left), getattr(r, right)
            if a not in got and b not in used:
                got[a] = b
                used.add(b)
        out = pd.DataFrame([(a, got.get(a)) for a in sorted(pdf[left].unique())], columns=[left, right])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return shared.groupBy(*keys).applyInPandas(run, schema)


def with_fresh(matches: DataFrame, keys: list[str], left: str, right: str, mark: str = "new-") -> DataFrame:
    """Left labels that found no partner get names of their own: numbered in a group in the order of the labels."""
    nth = F.count_if(F.col(right).isNull()).over(Window.partitionBy(*keys).orderBy(left))
    return matches.withColumn(right, F.coalesce(right, F.concat(F.lit(mark), nth.cast("string"))))


def best_apart(weight: dict, apart: set) -> dict:
    """left -> right of the greatest sum of positive weights (left, right) where no two lefts of ``apart`` share a right.

    Others may share one. Of equal sums the one whose rights come first, in the order of the lefts, none last. Branch and
    bound: what is open can add no more than each left's best weight.
    """
    lefts = sorted({a for a, _ in weight})
    options = {a: sorted(((w, b) for (x, b), w in weight.items() if x == a and w > 0), key=lambda o: o[1]) for a in lefts}
    room = [0] * (len(lefts) + 1)
    for k in range(len(lefts) - 1, -1, -1):
        room[k] = room[k + 1] + max((w for w, _ in options[lefts[k]]), default=0)
    best: list = [-1, {}]

    def go(k: int, total, got: dict) -> None:
        if total + room[k] <= best[0]:
            return
        if k == len(lefts):
            best[:] = [total, dict(got)]
            return
        a = lefts[k]
        for w, b in options[a]:
            if not any(got.get(c) == b and ((a, c) in apart or (c, a) in apart) for c in lefts[:k]):
                go(k + 1, total + w, got | {a: b})
        go(k + 1, total, got)

    go(0, 0, {})
    return best[1]


def matches_apart(shared: DataFrame, apart: DataFrame, keys: list[str], left: str, right: str, weight: str) -> DataFrame:
    """The best assignment (keys, left, right) of local to global labels where ``apart`` (keys, a, b) lists the local ones
    that may not share a global one; a local label without one comes with a null. A group is what one window holds."""
    types = dict(shared.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, left, right))

    def run(some: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        got = best_apart({(a, b): w for a, b, w in zip(some[left], some[right], some[weight], strict=True)}, set(zip(pairs["a"], pairs["b"], strict=True)))
        out = pd.DataFrame([(a, got.get(a)) for a in sorted(some[left].unique())], columns=[left, right])
        for k in reversed(keys):
            out.insert(0, k, some[k].iloc[0] if len(some) else None)
        return out

    return shared.groupBy(*keys).cogroup(apart.groupBy(*keys)).applyInPandas(run, schema)


def agglomerate(x: np.ndarray, threshold: float, most: int = 128, size: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers by average linkage on cosine: the closest pair merges while its cosine is at least ``threshold``, or
    while there are more than ``most`` clusters. Numbers follow first members. (Our own choice of linkage.)

    With ``size`` the rows are sums of so many unit vectors each: clusters that were found apart are merged further.

    The mean cosine of two clusters is the product of their sums of unit vectors over their sizes, so no matrix of pairs is
    held. Chains of nearest neighbours find all merges, which are then taken from the closest on."""
    n = len(x)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    sums = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) if size is None else x.copy()
    size, alive = np.ones(n) if size is None else size.astype(float), np.ones(n, bool)
    height, merges, chain = np.full(n, np.inf), [], []
    while len(merges) < n - 1:
        chain = chain or [int(alive.argmax())]
        i = chain[-1]
        sim = np.where(alive, sums @ sums[i] / (size * size[i]), -np.inf)
        sim[i] = -np.inf
        j = int(sim.argmax())
        if len(chain) == 1 or sim[chain[-2]] < sim[j] - 1e-12:
            chain.append(j)
            continue
        j = chain[-2]
        del chain[-2:]
        a, b = min(i, j), max(i, j)
        height[a] = min(sim[j], height[a], height[b])  # no merge before those it consists of
        merges.append((height[a], a, b))
        sums[a] += sums[b]
        size[a] += size[b]
        alive[b] = False
    label, left = np.arange(n), n
    for h, a, b in sorted(merges, key=lambda m: -m[0]):
        if h < threshold and left <= most:
            break
        label[label == b] = a
        left -= 1
    return np.unique(label, return_inverse=True)[1]


def dissolve(x: np.ndarray, label: np.ndarray, least: int) -> np.ndarray:
    """Members of clusters under ``least`` go to the cluster whose centroid is nearest by cosine, the first of equals.

    Where no cluster has enough members all stay. Numbers follow first members.
    """
    n = np.bincount(label)
    if (n >= least).all() or not (n >= least).any():
        return label
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    centre = np.zeros((len(n), x.shape[1]))
    np.add.at(centre, label, unit)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-300)
    near = unit @ centre.T
    near[:, n < least] = -np.inf
    out = np.where(n[label] < least, near.argmax(axis=1), label)
    _, first, where = np.unique(out, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[where]


def cluster_vectors(df: DataFrame, keys: list[str], row: str, vector: str, threshold: float, least: int = 1) -> DataFrame:
    """Cluster number of each vector in its group (a meeting's channel, which bounds a group); clusters under ``least``
    members are dissolved."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, row)) + ", cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        out, x = pdf[[*keys, row]].copy(), np.stack(pdf[vector]).astype(float)
        out["cluster"] = dissolve(x, agglomerate(x, threshold), least).astype("int32")
        return out

    return df.select(*keys, row, vector).groupBy(*keys).applyInPandas(run, schema)


def cluster_in_blocks(df: DataFrame, keys: list[str], row: str, vector: str, threshold: float, block: int = 2048) -> DataFrame:
    """As ``cluster_vectors`` for groups of any size: blocks of about so many rows are clustered apart, and then their
    clusters by sums and sizes. A group of one block has the clusters of ``cluster_vectors``; in a larger one members of
    different blocks join only as clusters. Numbers follow the smallest row of each cluster."""
    types = dict(df.dtypes)
    n = df.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = df.select(*keys, row, vector).join(n, keys).withColumn("_block", F.pmod(F.xxhash64(row), F.col("_blocks")))
    kept = ", ".join(f"{k} {types[k]}" for k in keys)

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        x = np.stack(pdf[vector]).astype(float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        label = agglomerate(x, threshold)
        sums = np.zeros((label.max() + 1, x.shape[1]))
        np.add.at(sums, label, unit)
        out = pdf[[*keys, row, "_block"]].copy()
        out["part"], first = label.astype("int32"), np.unique(label, return_index=True)[1]
        size = np.bincount(label)
        out["sums"] = [sums[c] if k == first[c] else None for k, c in enumerate(label)]
        out["size"] = size[label]
        return out

    parts = dealt.groupBy(*keys, "_block").applyInPandas(apart, f"{kept}, {row} {types[row]}, _block long, part int, sums array<double>, size long")

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        out = pdf[[*keys, "_block", "part"]].copy()
        out["cluster"] = agglomerate(np.stack(pdf["sums"]).astype(float), threshold, size=pdf["size"].to_numpy()).astype("int32")
        return out

    whole = parts.where("sums is not null").groupBy(*keys).applyInPandas(together, f"{kept}, _block long, part int, cluster int")
    return parts.select(*keys, row, "_block", "part").join(whole, [*keys, "_block", "part"]).select(*keys, row, "cluster")


def near_cuts(samples: np.ndarray, most: int, radius: int, window: int, step: int, least: int, quiet: float, overlap: int) -> list[tuple[int, int]]:
    """Pieces (from, to) of at most about ``most`` samples, cut in the middle of the quietest window near each target.

    Windows start ``step`` apart from ``radius`` before the target (``least`` behind the piece's start, if later) to
    ``radius`` behind it; the first of equally quiet ones counts. Where its root mean square is above ``quiet`` the piece
    runs on by ``overlap``, and where no window fits it ends there. Energies come from prefix sums.
    """
    total = len(samples)
    energy = np.concatenate([[0], np.cumsum(samples * samples)])
    out, at = [], 0
    while total - at > most:
        target = at + most
        low, high = max(target - radius, at + least), min(target + radius, total - window)
        starts = np.arange(low, high - window + 1, step) if low + window <= high else np.zeros(0, np.int64)
        cut, loud = target, True
        if len(starts):
            sums = energy[starts + window] - energy[starts]
            k = int(sums.argmin())
            cut, loud = int(starts[k]) + window // 2, sums[k] > quiet * quiet * window
        end = min(cut + overlap, total) if loud else cut
        out.append((at, end))
        at = end
    return [*out, (at, total)] if total > at else out


def pieces_near(most: int, radius: int, window: int, step: int, least: int, quiet: float, overlap: int):
    """``near_cuts`` as a column function over arrays of samples."""
    from ..functions.text import arrow

    @arrow("array<struct<from_sample:int,to_sample:int>>")
    def run(samples: pd.Series) -> pd.Series:
        cut = lambda x: [{"from_sample": a, "to_sample": b} for a, b in near_cuts(np.asarray(x, dtype=np.float64), most, radius, window, step, least, quiet, overlap)]
        return samples.map(lambda x: None if x is None else cut(x))

    return run


def pack_pieces(lengths: list[int], most: int, pause: int) -> list[int]:
    """Pack number of consecutive pieces: a pack holds at most ``most`` with ``pause`` between pieces (one piece at least)."""
    out, pack, used = [], -1, 0
    for n in lengths:
        if pack < 0 or used + pause + n > most:
            pack, used = pack + 1, n
        else:
            used += pause + n
        out.append(pack)
    return out


def pack_spans(df: DataFrame, keys: list[str], order: list[str], most_ms: int, pause_ms: int) -> DataFrame:
    """Spans with the pack they go to."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", pack int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(pack=np.array(pack_pieces((pdf["end_ms"] - pdf["start_ms"]).tolist(), most_ms, pause_ms), dtype="int32"))

    return df.groupBy(*keys).applyInPandas(run, schema)


def placed(packs: DataFrame, keys: list[str], order: list[str], pause_ms: int) -> DataFrame:
    """Packed spans with their place in the pack (at_start, at_end): one behind the other with pauses between."""
    w = Window.partitionBy(*keys, "pack").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_ms") - F.col("start_ms")
    p = packs.withColumn("at_start", F.coalesce(F.sum(length + pause_ms).over(w), F.lit(0)))
    return p.withColumn("at_end", F.col("at_start") + length)


def map_back(said: DataFrame, packs: DataFrame, keys: list[str], ident: list[str]) -> DataFrame:
    """What was said at places of a pack (said_start, said_end) as times of the span there: that which holds the middle,
    else the nearest, the first of equals; cut to the span. A pack's spans are few, so its pairs are too."""
    middle = F.col("said_start") + F.col("said_end")
    off = F.greatest(2 * F.col("at_start") - middle, middle - 2 * F.col("at_end") + 1, F.lit(0))
    rest = [c for c in packs.columns if c not in keys]
    near = said.join(packs, keys).groupBy(*keys, *ident, "said_start", "said_end").agg(F.min_by(F.struct(*rest), F.struct(off, "at_start")).alias("_p"))
    inside = lambda c: F.col("_p.start_ms") + F.greatest(F.lit(0), F.least(F.col("_p.end_ms") - F.col("_p.start_ms"), F.col(c) - F.col("_p.at_start")))
    return near.select(*keys, *ident, *[F.col(f"_p.{c}").alias(c) for c in rest if c not in ("start_ms", "end_ms")], inside("said_start").alias("start_ms"), inside("said_end").alias("end_ms"))


def quiet_cuts(samples: np.ndarray, most: int, window: int, hop: int) -> list[int]:
    """Places where samples longer than ``most`` are cut: the quietest window off the first and last tenth, and so on in
    both parts; the middle if they are too short for a window."""
    n = len(samples)
    if n <= most or n < 2:
        return []
    lo, hi = n // 10, n - n // 10 - window
    if hi <= lo:
        cut = n // 2
    else:
        power = np.concatenate([[0.0], np.cumsum(samples.astype(float) ** 2)])
        starts = np.arange(lo, hi + 1, hop)
        cut = int(starts[(power[starts + window] - power[starts]).argmin()]) + window // 2
    return quiet_cuts(samples[:cut], most, window, hop) + [cut] + [cut + c for c in quiet_cuts(samples[cut:], most, window, hop)]


def quiet_cut_places(most: int, window: int, hop: int):
    """A function of sample arrays to the places of their cuts."""
    from ..functions.text import arrow

    @arrow("array<int>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else quiet_cuts(np.asarray(a), most, window, hop))

    return run


def viterbi_align(log_p: np.ndarray, targets: list[int], blank: int = 0) -> list[tuple[int, int]]:
    """First and last frame of each target symbol on the best monotone path of frames x symbols log posteriors, blanks
    between and around them."""
    frames, path = len(log_p), [blank]
    for t in targets:
        path += [t, blank]
    s = len(path)
    score, back = np.full((frames, s), -np.inf), np.zeros((frames, s), dtype=np.int8)
    score[0, 0] = log_p[0, blank]
    if s > 1:
        score[0, 1] = log_p[0, path[1]]
    for f in range(1, frames):
        for j in range(s):
            options = [score[f - 1, j], score[f - 1, j - 1] if j else -np.inf]
            if j > 1 and path[j] != blank and path[j] != path[j - 2]:
                options.append(score[f - 1, j - 2])
            back[f, j] = int(np.argmax(options))
            score[f, j] = options[back[f, j]] + log_p[f, path[j]]
    j = s - 1 if s == 1 or score[-1, s - 1] >= score[-1, s - 2] else s - 2
    spans: dict[int, list[int]] = {}
    for f in range(frames - 1, -1, -1):
        if j % 2:
            spans.setdefault(j // 2, [f, f])[0] = f
        j -= int(back[f, j])
    return [tuple(spans[k]) for k in sorted(spans)]


def weave_sources(df: DataFrame, key: str, source: str, text: str, pivot: str) -> DataFrame:
    """One text a key: the pivot source's words, outvoted by the aligned words of the others. Words end at ASCII white space."""
    from ..functions.text import confusion_vote

    space = re.compile(r"[ \t\n\r\f]+")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        said = {r[0]: [w for w in space.split(r[1] or "") if w] for r in pdf[[source, text]].itertuples(index=False)}
        base = said.pop(pivot, [])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "voted": [" ".join(confusion_vote(base, [said[k] for k in sorted(said)]))]})

    return df.select(key, source, text).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, voted string")


def exploded_tokens(df: DataFrame, row: list[str], text: str) -> DataFrame:
    """Tokens of a row with times spread evenly over it: pos, text, start_ms, end_ms."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\r\n\f\x0B]+"), F.lit(0))
    out = df.withColumn("_n", F.size(words)).select(*row, "start_ms", "end_ms", "_n", F.posexplode(words).alias("pos", "token"))
    at = lambda k: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("_n"))
    return out.select(*row, "pos", F.col("token").alias("text"), at(F.col("pos")).alias("s"), at(F.col("pos") + 1).alias("e")).withColumnsRenamed({"s": "start_ms", "e": "end_ms"})
