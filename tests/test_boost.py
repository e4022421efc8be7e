import numpy as np
import pytest

from grantrisk.operators import boost


def brute_tree(x, y, w, margin, depth, rate, gamma, least, reg):
    """{row: leaf value} of one tree grown with all sums taken directly."""
    p = 1 / (1 + np.exp(-margin))
    g, h, out = w * (p - y), w * p * (1 - p), np.zeros(len(y))

    def grow(rows, level):
        G, H = g[rows].sum(), h[rows].sum()
        out[rows] = -rate * G / (H + reg)
        best = None
        for f in range(x.shape[1]) if level < depth else []:
            v = x[rows, f]
            for b, cut in enumerate(np.unique(x[~np.isnan(x[:, f]), f])):
                for missing_left in (False, True):
                    left = rows[np.where(np.isnan(v), missing_left, v <= cut)]
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl < least or H - hl < least or hl <= 0 or H - hl <= 1e-12:
                        continue
                    gain = round((gl ** 2 / (hl + reg) + (G - gl) ** 2 / (H - hl + reg) - G ** 2 / (H + reg)) / 2 - gamma, 9)
                    if gain > 0 and (best is None or (gain, -f, -b, not missing_left) > best[0]):
                        best = ((gain, -f, -b, not missing_left), left)
        if best:
            grow(best[1], level + 1)
            grow(np.setdiff1d(rows, best[1]), level + 1)

    grow(np.arange(len(y)), 0)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 6, 300).astype(float), rng.integers(0, 4, 300).astype(float), rng.normal(size=300).round(1)], axis=1)
    x[rng.random(300) < 0.3, 1] = np.nan
    y = ((x[:, 0] > 2) ^ np.isnan(x[:, 1]) ^ (rng.random(300) < 0.15)).astype(float)
    w = 1.0 + (np.arange(300) % 3)
    rows = [(i, int(y[i]), float(w[i]), *[None if np.isnan(v) and i % 2 else float(v) for v in x[i]]) for i in range(300)]
    return x, y, w, spark.createDataFrame(rows, "row_id long, label int, weight double, a double, b double, c double").cache()


@pytest.mark.parametrize("params", [{"max_depth": 2}, {"max_depth": 4, "gamma": 0.4, "min_child_weight": 3.0, "learning_rate": 0.1}])
def test_trees_are_those_grown_by_hand(data, params):
    x, y, w, df = data
    p = {**boost.DEFAULTS, **params, "n_estimators": 3}
    model = boost.fit(df, ["a", "b", "c"], p, weight="weight")
    margin = np.zeros(300)
    for _ in range(3):
        margin += brute_tree(x, y, w, margin, p["max_depth"], p["learning_rate"], p["gamma"], p["min_child_weight"], p["reg_lambda"])
    got = {r.row_id: r.margin for r in boost.predict(df, model).collect()}
    assert np.allclose([got[i] for i in range(300)], margin, atol=1e-9)


def test_contributions_add_up_to_the_margin(data, spark):
    df = data[3]
    model = boost.fit(df, ["a", "b", "c"], {"n_estimators": 6, "max_depth": 3}, weight="weight")
    rows = boost.contributions(df, model).join(boost.predict(df, model), "row_id").collect()
    assert len(rows) == 300
    assert all(r.base + sum(r.contribution) == pytest.approx(r.margin, abs=1e-9) for r in rows)
    used = {r.column for r in model.importances(spark).collect()}
    assert all(c in used or all(r.contribution[i] == 0 for r in rows) for i, c in enumerate(model.columns))
    assert sum(r.prediction == r.label for r in rows) > 230


def test_subsamples_are_the_same_again(data):
    df = data[3]
    p = {"n_estimators": 2, "max_depth": 2, "subsample": 0.6, "colsample_bytree": 0.5}
    one, two = (boost.fit(df.repartition(n), ["a", "b", "c"], p) for n in (2, 5))
    for s, t in zip(one.trees, two.trees):
        assert (s.feature == t.feature).all() and np.allclose(s.value, t.value)


def test_rows_without_label_values_or_a_split(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 0, None), (3, None, 4.0), (4, 1, float("nan"))], "row_id long, label int, a double")
    model = boost.fit(df, ["a"], {"n_estimators": 2, "max_depth": 2})
    got = boost.predict(df, model).collect()
    assert len(got) == 4 and len({r.margin for r in got}) == 1 and got[0].margin > 0
    none = boost.fit(df.limit(0), ["a"], {"n_estimators": 1, "max_depth": 1})
    assert boost.predict(df, none).first().probability == 0.5
    with pytest.raises(ValueError):
        boost.fit(df, ["a"], {"max_depth": 40})


@pytest.mark.parametrize("cells", [boost.MAX_CELLS, 0])
def test_a_level_costs_the_same_whatever_trees_came_before(data, monkeypatch, cells):
    x, y, w, df = data
    plans, best = [], boost.best_splits

    def seen(sums, *args):
        plans.append(sums._jdf.queryExecution().logical().toString())
        return best(sums, *args)

    monkeypatch.setattr(boost, "best_splits", seen)
    monkeypatch.setattr(boost, "MAX_CELLS", cells)
    p = {**boost.DEFAULTS, "n_estimators": 7, "max_depth": 2}
    model = boost.fit(df, ["a", "b", "c"], p, weight="weight")
    assert len({p.count("\n") for p in plans}) == 1 and not any("explode" in p for p in plans)
    margin = np.zeros(300)
    for _ in range(7):
        margin += brute_tree(x, y, w, margin, 2, p["learning_rate"], p["gamma"], p["min_child_weight"], p["reg_lambda"])
    got = {r.row_id: r.margin for r in boost.predict(df, model).collect()}
    assert np.allclose([got[i] for i in range(300)], margin, atol=1e-9)
