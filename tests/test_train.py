from pyspark.sql import functions as F

from grantrisk.operators import learn
from grantrisk.plans import queries as Q
from grantrisk.plans import train

SF = "/root/testdata/sf0.001"


def test_experiment_with_resampled_phase(spark):
    feats = Q.features(spark, SF)
    out = train.experiment(feats, variants=("sem_municipio_orgao",), models=("logit",),
                           resample=[("smote", 1.0), ("nearmiss", 1.0), ("smote", 0.01)],
                           tune_iter=2, tune_folds=2)
    phases = {(r["phase"], r["resampler"]) for r in out.select("phase", "resampler").distinct().collect()}
    assert phases == {("default", None), ("tuned", None), ("resampled", "smote"), ("resampled", "nearmiss")}
    odd = out.filter("metric = 'infeasible'").select("resampler", "ratio", "value").collect()
    assert [tuple(r) for r in odd] == [("smote", 0.01, None)]
    vals = [r["value"] for r in out.filter(F.col("metric") == "AUC").collect()]
    assert all(v is not None and 0.0 <= v <= 1.0 for v in vals)


def test_search_and_refit(spark):
    m = train.build_matrices(Q.features(spark, SF), "sem_municipio_orgao")
    tr = m.linear.filter(F.col("split") == "train")
    from grantrisk.operators import balance as bal
    folds = bal.stratified_folds(tr, "label", "row_id", k=3)
    cands = learn.draw_candidates(learn.LOGIT_SPACE, 2)
    assert cands == learn.draw_candidates(learn.LOGIT_SPACE, 2)  # seeded
    trials = learn.search(spark, lambda c, d: train.make_estimator("logit", c, d), cands, folds, k=3)
    assert trials.count() == 2
    best = learn.best_candidate(trials)
    _, pred, rows = train.fit_eval("logit", best, m)
    assert pred.count() == m.linear.filter(F.col("split") == "test").count()
    assert rows.count() == 6
    assert len(learn.grid_candidates(learn.GBT_GRID)) == 90


def test_a_search_that_ended_midway_goes_on(spark, tmp_path):
    import pytest
    from pyspark.ml.linalg import Vectors

    from grantrisk.operators import learn
    df = spark.createDataFrame([(i, i % 2, 1.0, i % 3, Vectors.dense([float(i % 2) + (i % 5) / 4])) for i in range(60)],
                               ["row_id", "label", "weight", "fold", "features"])
    cands, made = [{"C": c} for c in (0.1, 1.0, 10.0)], []

    def make(c, tr):
        if len(made) == 4 and "stop" in made:
            raise RuntimeError("executor gone")
        made.append(c["C"])
        return learn.logit(c, n_rows=40)

    whole = learn.search(spark, lambda c, tr: learn.logit(c, n_rows=40), cands, df, k=3).collect()
    path, made[:] = str(tmp_path / "ledger"), ["stop"]
    with pytest.raises(RuntimeError):
        learn.search(spark, make, cands, df, k=3, parallelism=1, ledger=path, tag="logit")
    made.remove("stop")
    again = learn.search(spark, make, cands, df, k=3, parallelism=1, ledger=path, tag="logit").collect()
    assert again == whole and len(made) == 9  # three folds of three candidates, none twice
    assert learn.search(spark, make, cands, df.orderBy("features"), k=3, ledger=path, tag="logit").collect() == whole and len(made) == 9
    learn.search(spark, make, cands[:1], df.where("row_id > 0"), k=3, ledger=path, tag="logit")
    assert len(made) == 12  # other data, other fits


def test_grid_candidates_that_differ_in_rounds_share_a_fit(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(i, int((i * 7) % 5 > 1) ^ int(i % 11 == 0), 1.0 + i % 2, i % 3, Vectors.dense([float((i * 7) % 5), float(i % 13), float(i % 4)]))
                                for i in range(240)], ["row_id", "label", "weight", "fold", "features"]).coalesce(1).cache()
    grid, fits = {"learning_rate": [0.1, 0.5], "max_depth": [2], "n_estimators": [2, 5, 3]}, []

    def make(c, tr):
        fits.append(c["n_estimators"])
        return learn.gbt(c)

    cands = learn.grid_candidates(grid)
    alone = learn.search(spark, make, cands, df, k=3).collect()
    assert len(fits) == 18
    fits.clear()
    assert learn.search(spark, make, cands, df, k=3, rounds="n_estimators").collect() == alone
    assert fits == [5] * 6 and len({r["score"] for r in alone}) > 2


def test_the_grid_query_searches_the_whole_grid(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(Q, "_mats", lambda *a, **k: "matrices")
    monkeypatch.setattr(train, "grid_search", lambda m, grid=None, folds=10, **k: seen.update(m=m, n=len(learn.grid_candidates(grid or learn.GBT_GRID)), folds=folds))
    Q.q_grid(spark, SF)
    assert seen == {"m": "matrices", "n": 90, "folds": 10}


def test_the_experiment_query_has_every_phase(spark, monkeypatch):
    import inspect
    real, seen = inspect.signature(train.experiment), []
    monkeypatch.setattr(Q, "features", lambda *a, **k: "features")
    monkeypatch.setattr(train, "experiment", lambda *a, **k: seen.append(real.bind(*a, **k)))
    Q.q_experiment(spark, SF)
    seen[0].apply_defaults()
    a = seen[0].arguments
    assert a["params"] is None and a["tune_iter"] == 20 and a["tune_folds"] == 10 and len(a["variants"]) == len(a["models"]) == 3
    assert sorted(a["resample"]) == sorted((m, r) for m in ("smote", "nearmiss", "smote_nearmiss") for r in (0.1, 0.2, 1.0))
    assert a["resample_variants"] is a["resample_models"] is None
