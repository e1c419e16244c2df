"""The quality classifier's parts: rules as columns against plain evaluation, the lasso against its optimality conditions."""

from __future__ import annotations

import math

import numpy as np

from colloquy.llm import rules


def plain(ensemble, row):
    """A score by reading the rules one by one."""
    total = ensemble.intercept
    for rule, weight in ensemble.rules:
        if all((row[f] > t) == above for f, above, t in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def labelled(rng, n):
    x = np.abs(rng.normal(size=(n, len(rules.STATISTICS))))
    y = ((x[:, 2] > 0.8) & (x[:, 5] <= 1.0) | (x[:, 9] > 1.6)).astype(float)
    flip = rng.random(n) < 0.05
    return x, np.where(flip, 1 - y, y)


def test_columns_equal_plain_rules(spark):
    rng = np.random.default_rng(1)
    x, y = labelled(rng, 1500)
    model = rules.fit(x, y)
    assert len(model.rules) > 3
    edge = np.array([[t if f == k else 0.0 for k in range(x.shape[1])] for rule, _ in model.rules for f, _, t in rule])  # on the thresholds
    rows = np.concatenate([x[:200], edge, np.zeros((1, x.shape[1]))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} double" for c in rules.STATISTICS))
    got = {r.i: r.score for r in df.select("i", model.column().alias("score")).collect()}
    assert all(abs(got[i] - plain(model, r)) < 1e-12 for i, r in enumerate(rows))
    for rule, _ in model.rules:
        assert (rules.fires(rule, rows) == [all((r[f] > t) == above for f, above, t in rule) for r in rows]).all()


def test_paths_are_conjunctions_of_a_tree():
    rng = np.random.default_rng(2)
    x, y = labelled(rng, 800)
    found = rules.grow_rules(x, y, trees=3, depth=3)
    assert len(found) == len(set(found)) and all(1 <= len(r) <= 3 for r in found)
    for rule in found:  # every path has its parent and its sibling
        if len(rule) > 1:
            parents = [tuple(sorted(rule[:k] + rule[k + 1 :])) for k in range(len(rule))]
            assert any(p in found for p in parents)


def test_lasso_is_optimal():
    rng = np.random.default_rng(3)
    x, y = labelled(rng, 1000)
    found = rules.grow_rules(x, y, trees=6)
    a = np.stack([rules.fires(r, x) for r in found], axis=1).astype(float)
    penalty = 5e-3
    w, b = rules.lasso(a, y, penalty, rounds=20_000)
    p = 1 / (1 + np.exp(-(a @ w + b)))
    slope = a.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-5 and 0 < (w != 0).sum() < len(w)
    assert np.abs(slope[w != 0] + penalty * np.sign(w[w != 0])).max() < 1e-4
    assert np.abs(slope[w == 0]).max() <= penalty + 1e-4


def test_the_lasso_of_production_is_near_its_optimum():
    rng = np.random.default_rng(4)
    x, y = labelled(rng, 1000)
    a = np.stack([rules.fires(r, x) for r in rules.grow_rules(x, y)], axis=1).astype(float)

    def loss(w, b):
        z = a @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + rules.PENALTY * np.abs(w).sum()

    assert loss(*rules.lasso(a, y)) < loss(*rules.lasso(a, y, rounds=10_000)) + 2e-3


def test_one_class_and_no_rows():
    for y, rate in (([1.0, 1.0], 3 / 4), ([0.0], 1 / 3), ([], 1 / 2)):
        model = rules.fit(np.zeros((len(y), len(rules.STATISTICS))), np.array(y))
        assert not model.rules and abs(plain(model, [0.0] * len(rules.STATISTICS)) - rate) < 1e-12
