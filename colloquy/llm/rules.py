"""A quality classifier as a sparse ensemble of rules over text statistics.

Statistics of every whole text are counted in Spark tasks. On a bounded, documented sample of labelled training rows
(``SAMPLE``, lowest hash of doc_id first) shallow trees are boosted on the logistic loss; every path from a root to a
node is one conjunctive rule. Lasso-penalised logistic weights (accelerated proximal gradient) leave few rules, and
these compile into one Spark column expression, so scoring is generated code over the statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below, cut, ship, slices

SAMPLE, TREES, DEPTH, CUTS, STEP, PENALTY, ROUNDS = 20_000, 24, 3, 32, 0.3, 1e-3, 400
STATISTICS = ("words", "mean_word", "upper", "digit", "symbol", "exclaim", "other_mark", "space", "high_byte", "line_words", "repeated_lines", "distinct_words", "top_word", "short_words", "period_words")

_CLASSES = np.zeros((256, 7))
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b"@:/=_()[]{}\\\"'+~^`-;?", b" \n\t\r", bytes(range(128, 256)))):
    _CLASSES[list(_set), _k] = 1


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS; all zero for null, empty and wordless texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, size = len(words), len(raw)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / size
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    short = sum(c for w, c in seen.items() if len(w) <= 3)
    period = sum(c for w, c in seen.items() if w[-1] == 46)
    return (float(n), size / n, *map(float, share), n / len(lines), 1 - len(set(lines)) / len(lines), len(seen) / n, max(seen.values()) / n, short / n, period / n)


def _measure(batches):
    for batch in batches:
        for part in slices(batch, 1024, 8 << 20):
            x = np.array([statistics(t) for t in part.column("text").to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in x.T)], ["doc_id", *STATISTICS])


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    ship(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold) and (...)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """All root-to-node paths of boosted trees, without repeats, in the order found."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(t, c, side="left") for t, c in zip(cuts, x.T, strict=True)], axis=1)
    score, rules = np.zeros(len(y)), {}

    def grow(rows: np.ndarray, path: Rule, g: np.ndarray, h: np.ndarray) -> None:
        if path:
            rules.setdefault(tuple(sorted(path)))
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 20:
            for f, t in enumerate(cuts):
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(t) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(t) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 1) | (hs - hl < 1)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            score[rows] += STEP * gs / (hs + 1)
            return
        f, b = best[1]
        above = binned[rows, f] > b
        for side in (False, True):
            grow(rows[above == side], (*path, (f, side, float(cuts[f][b]))), g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grow(np.arange(len(y)), (), y - p, p * (1 - p))
    return list(rules)


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-penalised mean logistic loss; the intercept is free."""
    n, k = a.shape
    rate = 4 * n / max(1e-9, np.linalg.norm(np.concatenate([a, np.ones((n, 1))], axis=1), 2) ** 2)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a @ v[:-1] + v[-1])))
        new = v - rate * np.append(a.T @ (p - y), (p - y).sum()) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - rate * penalty)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


class Ensemble:
    """Rules with weights and an intercept."""

    def __init__(self, rules: list[Rule], weights: np.ndarray, intercept: float):
        self.rules = [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w]
        self.intercept = intercept

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for f, above, t in rule:
                test &= (F.col(STATISTICS[f]) > t) if above else (F.col(STATISTICS[f]) <= t)
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def text(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'>' if up else '<='} {t:.4g}" for f, up, t in r) for r, w in self.rules]


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and weights; with rows of one class only (or none) just the smoothed rate of label 1."""
    if len(np.unique(y)) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return Ensemble([], np.zeros(0), float(np.log(rate / (1 - rate))))
    rules = grow_rules(x, y)
    return Ensemble(rules, *lasso(np.stack([fires(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0)), y))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1 (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5) for every row of documents, whole texts.

    Training rows are labelled ids that are not held out; an id with several labels counts as 1 if their mean is at
    least a half; null labels do not count. A null or empty text has zero statistics and the score these get. Without
    usable labels every score is the smoothed rate. Rows with a null id are scored. Repeated rows are scored each.
    """
    measured = cut(measure(documents))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    both, low = known.join(measured, "doc_id"), F.xxhash64("doc_id")
    train = both.where(below(low, sample, both.count())).orderBy(low, "doc_id").limit(sample).toPandas()
    model = fit(train[list(STATISTICS)].to_numpy(dtype=np.float64), train["y"].to_numpy(dtype=np.float64))
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
