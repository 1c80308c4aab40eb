"""The fits of the two classifiers against plain loops."""

import math
import random

import numpy as np
import pytest

from shelfmark.llm import quality, toxicity


def plain_em(votes, n, y, rounds):
    """Expectation and maximisation row by row, voter by voter."""
    width, hand = len(votes[0]), len(votes[0]) - len(toxicity.PATTERNS)
    labelled = {k for k in y if k >= 0} == {0, 1}
    n = [m * (toxicity.UNLABELLED if labelled and k < 0 else 1) for m, k in zip(n, y)]
    p = [float(k) if k >= 0 else (0.8 if any(v[:hand]) else 0.02) for v, k in zip(votes, y)]
    for _ in range(rounds):
        weights = [[m * (1 - q) for m, q in zip(n, p)], [m * q for m, q in zip(n, p)]]
        rates = [[min(1 - 1e-4, max(1e-4, (sum(w for w, v in zip(ws, votes) if v[j]) + 0.5) / (sum(ws) + 1))) for j in range(width)] for ws in weights]
        prior = min(0.99, max(0.01, sum(weights[1]) / sum(n)))
        discount = [1.0] * width
        shared = [[0.0] * width for _ in range(width)]
        for c, ws in enumerate(weights):
            of = max(1.0, sum(ws))
            cov = [[sum(w * (v[i] - rates[c][i]) * (v[j] - rates[c][j]) for w, v in zip(ws, votes)) / of for j in range(width)] for i in range(width)]
            sd = [math.sqrt(cov[i][i]) + 1e-6 for i in range(width)]
            for i in range(width):
                for j in range(width):
                    if i != j:
                        shared[i][j] += cov[i][j] / sd[i] / sd[j] * sum(ws) / sum(n)
        discount = [1 + sum(max(0.0, s) for s in shared[i]) for i in range(width)]
        for r, (v, k) in enumerate(zip(votes, y)):
            z = math.log(prior / (1 - prior))
            for j in range(width):
                a, b = rates[1][j], rates[0][j]
                z += (math.log(a / b) if v[j] else math.log((1 - a) / (1 - b))) / discount[j]
            p[r] = float(k) if k >= 0 else 1 / (1 + math.exp(-min(50, max(-50, z))))
    return prior, rates, discount, p


@pytest.mark.parametrize("seed,known", [(1, 0.3), (2, 0.0), (3, 1.0)])
def test_label_model_equals_a_plain_loop(seed, known):
    rng = random.Random(seed)
    width = 4 + len(toxicity.PATTERNS)
    votes, n, y = [], [], []
    for _ in range(70):
        bad = rng.random() < 0.3
        row = [rng.random() < (0.7 if bad else 0.1) for _ in range(width)]
        row[1] = row[0] if rng.random() < 0.9 else row[1]  # two voters that copy one another
        votes.append(row)
        n.append(rng.randrange(1, 5))
        y.append(int(bad) if rng.random() < known else -1)
    model = toxicity.label_model(np.array(votes), np.array(n, float), np.array(y), rounds=12)
    prior, rates, discount, p = plain_em(votes, n, y, 12)
    assert model.prior == pytest.approx(prior) and np.allclose(model.rates, rates) and np.allclose(model.discount, discount)
    free = [i for i, k in enumerate(y) if k < 0]
    assert np.allclose(model.posterior(np.array(votes))[free], np.array(p)[free])
    assert model.discount[0] > model.discount[2] and model.discount[1] > model.discount[3]  # copies count less


def plain_lasso(z, y, penalty, rounds=4000):
    """One weight at a time: a step along its own gradient, no longer than its curvature allows, then shrunk."""
    n, d = len(z), len(z[0])
    w, bias = [0.0] * d, 0.0
    total = [0.0] * n
    for _ in range(rounds):
        moved = 0.0
        for j in range(d + 1):
            column = [1.0] * n if j == d else [row[j] for row in z]
            curve = sum(c * c for c in column) / 4 / n
            if not curve:
                continue
            slope = sum(c * (1 / (1 + math.exp(-t)) - k) for c, t, k in zip(column, total, y)) / n
            old = bias if j == d else w[j]
            new = old - slope / curve
            if j < d:
                new = math.copysign(max(0.0, abs(new) - penalty / curve), new)
                w[j] = new
            else:
                bias = new
            for i, c in enumerate(column):
                total[i] += (new - old) * c
            moved = max(moved, abs(new - old))
        if moved < 1e-9:
            break
    return w, bias


@pytest.mark.parametrize("seed,penalty", [(1, 0.01), (2, 0.05), (3, 0.002)])
def test_lasso_equals_coordinate_descent(seed, penalty):
    rng = np.random.default_rng(seed)
    z = (rng.random((60, 5)) < 0.4).astype(float)
    y = (z[:, 0] + z[:, 1] - z[:, 2] + rng.normal(size=60) * 0.7 > 0.3).astype(float)
    w, bias = quality._lasso(z, y, penalty, steps=4000)
    plain, plain_bias = plain_lasso(z.tolist(), y.tolist(), penalty)
    assert np.allclose(w, plain, atol=1e-4) and bias == pytest.approx(plain_bias, abs=1e-4)
    assert [a != 0 for a in w] == [abs(a) > 1e-9 for a in plain]


def plain_walk(rows, y, bounds, features, depth, terms, out):
    """The same tree by counting both sides of every split."""
    if terms:
        out.add(quality.Rule(tuple(sorted(terms))))
    if not depth or len(rows) < 20 or sum(y) in (0, len(y)):
        return
    gini = lambda ys: sum(ys) * (1 - sum(ys) / max(1, len(ys)))
    best = (1e-9, None)
    for k in features:
        gains = []
        for bound in bounds[k]:
            right = [c for r, c in zip(rows, y) if r[k] > bound]
            left = [c for r, c in zip(rows, y) if r[k] <= bound]
            gains.append(gini(y) - gini(right) - gini(left) if min(len(left), len(right)) >= 5 else -1)
        at = max(range(len(gains)), key=lambda i: gains[i])
        if gains[at] > best[0] + 1e-12:
            best = (gains[at], (int(k), float(bounds[k][at])))
    if best[1] is None:
        return
    k, bound = best[1]
    for above in (True, False):
        kept = [(r, c) for r, c in zip(rows, y) if (r[k] > bound) == above]
        plain_walk([r for r, _ in kept], [c for _, c in kept], bounds, features, depth - 1, (*terms, (k, above, bound)), out)


def test_tree_paths_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 6))
    y = ((x[:, 1] > 0.2) ^ (x[:, 4] > -0.5) | (rng.random(240) < 0.1)).astype(float)
    bounds = [np.quantile(x[:, k], np.linspace(0.1, 0.9, 9)) for k in range(6)]
    for features in (np.array([0, 1, 4]), np.arange(6), np.array([2])):
        found, want = set(), set()
        quality._paths(x, y, bounds, features, 3, (), found)
        plain_walk(x.tolist(), y.tolist(), bounds, features.tolist(), 3, (), want)
        assert found == want and (len(found) > 6 or len(features) == 1)


def test_kept_rules_are_paths_of_the_trees():
    """Each rule of a fitted ensemble tells some rows from others (trees see rows drawn with repeats, so a node may be few rows)."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, len(quality.STATS)))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    model = quality.fit(x, y)
    assert model.rules and ((model.score(x) >= 0.5) == y).mean() > 0.95
    for rule in model.rules:
        held = [all((row[k] > bound) == above for k, above, bound in rule.terms) for row in x.tolist()]
        assert rule.holds(x).tolist() == held and 0 < sum(held) < len(held)


def test_lasso_takes_no_second_table():
    import tracemalloc

    z = (np.random.default_rng(1).random((3000, 400)) < 0.3).astype(np.float32)
    y = (z[:, 0] + z[:, 1] > 0).astype(np.float32)
    tracemalloc.start()
    w, _ = quality._lasso(z, y, 4e-4, steps=200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < z.nbytes / 4
    assert set(np.argsort(-w)[:2]) == {0, 1}
