"""Hand-computed values, invariants and error paths of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import errors, queries
from sparkloom.operators import cluster, compose, decomposition, encoders, imputers, linear, matrix, metrics, profile, report, scalers, selection, splits, stats
from sparkloom.operators.base import Model
from sparkloom.operators.linalg import cholesky_solve, pinv_solve
from sparkloom.plans import quantiles as q
from sparkloom.sources.models import load_model, save_model
from sparkloom.streaming.apply import transform_stream


def frame(spark, **cols):
    return matrix.from_columns(spark, cols)


def values(df, c="x"):
    return [r[c] for r in df.orderBy("rid").collect()]


def test_scalers_by_hand(spark):
    df = frame(spark, x=[1, 2, 3, 10], k=[5, 5, 5, 5])
    s = scalers.StandardScaler().fit(df, ["x", "k"])
    assert s.scale[0] == pytest.approx(math.sqrt(12.5))
    out = s.transform(df)
    assert values(out, "k") == [0, 0, 0, 0] and sum(values(out)) == pytest.approx(0)
    assert values(s.inverse_transform(out), "k") == [5] * 4
    m = scalers.MinMaxScaler(-1, 1).fit(df, ["x", "k"])
    assert values(m.transform(df)) == pytest.approx([-1, -7 / 9, -5 / 9, 1]) and values(m.transform(df), "k") == [-1] * 4
    assert values(m.inverse_transform(m.transform(df)), "k") == [5] * 4
    r = scalers.RobustScaler().fit(df, ["x"])
    assert (r.centre[0], r.scale[0]) == (2.5, 3.0)
    assert values(scalers.MaxAbsScaler().fit_transform(df, ["x"])) == pytest.approx([0.1, 0.2, 0.3, 1])
    assert values(scalers.Binarizer(2).fit_transform(df, ["x"])) == [0, 0, 1, 1]
    z = frame(spark, x=[3, 0], y=[4, 0])
    assert values(scalers.Normalizer("l2").fit_transform(z, ["x", "y"])) == pytest.approx([0.6, 0])


def test_scaler_errors(spark):
    with pytest.raises(errors.InvalidInput):
        scalers.StandardScaler().fit(spark.createDataFrame([(0, float("inf"))], "rid long, x double"), ["x"])
    with pytest.raises(errors.InvalidConfig):
        scalers.RobustScaler(low=0.0).fit(frame(spark, x=[1, 2]), ["x"])
    with pytest.raises(errors.ShapeMismatch):
        scalers.StandardScaler().fit(frame(spark, x=[1, 2]), ["x"]).transform(frame(spark, y=[1]))
    with pytest.raises(errors.NotFitted):
        scalers.StandardScaler().transform(frame(spark, x=[1]))
    with pytest.raises(errors.EmptyInput):
        scalers.StandardScaler().fit(frame(spark, x=[1]).where("x > 1"), ["x"])
    with pytest.raises(errors.InvalidInput):
        scalers.PowerTransformer("box-cox").fit(frame(spark, x=[0, 1]), ["x"])


def test_exact_quantiles_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(q, "SMALL", 3)
    monkeypatch.setattr(q, "BINS", 8)
    rng = random.Random(5)
    xs = [rng.choice([rng.gauss(0, 1), 0.0, 7.0, rng.uniform(-1e6, 1e6)]) for _ in range(500)]
    df = frame(spark, x=xs, k=[1] * 500)
    qs = [0, 0.01, 0.25, 0.5, 0.77, 1]
    got = q.exact_quantiles(df, {"x": qs, "k": qs}, 500)
    assert got["x"] == pytest.approx(np.quantile(xs, qs).tolist()) and got["k"] == [1] * 6
    many = [i / 99 for i in range(100)]
    assert q.exact_quantiles(df, {"x": many}, 500)["x"] == pytest.approx(np.quantile(xs, many).tolist())


def test_kbins_keeps_empty_bins_and_clamps(spark):
    df = frame(spark, x=[1, 1, 1, 1, 9])
    m = scalers.KBinsDiscretizer(4, "quantile").fit(df, ["x"])
    assert m.edges == [[1, 1, 1, 1, 9]] and values(m.transform(df)) == [0, 0, 0, 0, 3]
    assert values(m.transform(frame(spark, x=[-5, 20]))) == [0, 3]
    assert scalers.KBinsDiscretizer(3, "kmeans").fit(frame(spark, x=[0, 0.1, 5, 5.1, 9, 9.1]), ["x"]).edges[0] == pytest.approx([0, 2.55, 7.05, 9.1])


def test_quantile_and_power(spark):
    df = frame(spark, x=[1, 2, 3, 4, 5])
    assert values(scalers.QuantileTransformer(5).fit_transform(df, ["x"])) == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    assert values(scalers.QuantileTransformer(5, "normal").fit_transform(df, ["x"]))[2] == pytest.approx(0)
    rng = np.random.default_rng(1)
    xs = np.exp(rng.normal(size=400)).tolist()
    m = scalers.PowerTransformer("box-cox").fit(frame(spark, x=xs), ["x"])
    out = m.transform(frame(spark, x=xs))
    assert abs(m.lambdas[0]) < 0.15 and np.std(values(out)) == pytest.approx(1)
    assert values(m.inverse_transform(out)) == pytest.approx(xs)
    # Yeo-Johnson counts ln(1 + |x|) for negatives too (Q6).
    ys = rng.normal(size=200)
    grid = np.linspace(-1, 3, 4001)
    best = min(grid, key=lambda lam: 100 * math.log(np.var(scalers._power(ys, lam, "yeo-johnson"))) - (lam - 1) * np.log1p(np.abs(ys)).sum())
    assert scalers.PowerTransformer().fit(frame(spark, x=ys.tolist()), ["x"]).lambdas[0] == pytest.approx(best, abs=2e-3)


def test_polynomial_order(spark):
    m = scalers.PolynomialFeatures(2).fit(frame(spark, a=[2], b=[3]), ["a", "b"])
    assert m.names_out() == ["1", "a", "b", "a^2", "a b", "b^2"]
    assert list(m.transform(frame(spark, a=[2], b=[3])).drop("rid").first()) == [1, 2, 3, 4, 6, 9]


@pytest.fixture
def cities(spark):
    return spark.createDataFrame([(0, "x", 1.0), (1, "y", 3.0), (2, "x", 5.0), (3, "", 7.0)], "rid long, c string, y double")


def test_encoders(spark, cities):
    m = encoders.OneHotEncoder("first").fit(cities, ["c"])
    assert m.names_out() == ["c_x", "c_y"]
    assert values(m.inverse_transform(m.transform(cities)), "c") == ["x", "y", "x", ""]
    new = spark.createDataFrame([(0, "z", 0.0)], cities.schema)
    with pytest.raises(Exception, match="UnknownCategory"):
        m.transform(new).collect()
    assert encoders.OneHotEncoder(handle_unknown="ignore").fit(cities, ["c"]).transform(new).drop("rid", "y").first() == (0, 0, 0)
    o = encoders.OrdinalEncoder(handle_unknown="use_neg_one").fit(cities, ["c"])
    assert values(o.transform(cities), "c") == [1, 2, 1, 0] and values(o.transform(new), "c") == [-1]
    assert values(o.inverse_transform(o.transform(cities)), "c") == ["x", "y", "x", ""]
    assert values(encoders.FrequencyEncoder(True).fit_transform(cities, ["c"]), "c") == [0.5, 0.25, 0.5, 0.25]
    t = encoders.TargetEncoder(2.0).fit(cities, ["c"], "y")
    assert values(t.transform(cities), "c") == pytest.approx([(6 + 8) / 4, (3 + 8) / 3, 14 / 4, 15 / 3]) and values(t.transform(new), "c") == [4]
    assert values(encoders.LabelEncoder("ignore").fit(cities, ["c"]).transform(new), "c") == [None]


def test_large_dictionaries_are_joined(spark):
    df = spark.createDataFrame([(i, f"k{i % 600}") for i in range(1800)], "rid long, c string")
    out = encoders.FrequencyEncoder().fit_transform(df, ["c"])
    assert out.columns == ["rid", "c"] and out.where("c != 3").count() == 0 and out.count() == 1800


def test_dictionaries_that_stay_tables(spark, monkeypatch):
    rows = [(i, f"k{i % 300:03d}", f"s{i % 3}", float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "rid long, c string, d string, y double")
    fits = {
        "frequency": lambda: encoders.FrequencyEncoder().fit(df, ["c", "d"]), "target": lambda: encoders.TargetEncoder(2.0).fit(df, ["c", "d"], "y"),
        "ordinal": lambda: encoders.OrdinalEncoder().fit(df, ["c", "d"]), "label": lambda: encoders.LabelEncoder().fit(df, ["c"]),
    }
    held = {k: sorted(map(tuple, f().transform(df).collect())) for k, f in fits.items()}
    monkeypatch.setattr(encoders, "HELD", 100)
    for k, f in fits.items():
        m = f()
        assert m.values[0] == {} and m.tables[0] and sorted(map(tuple, m.transform(df).collect())) == held[k]
        again = Model.from_json(m.to_json())
        assert sorted(map(tuple, again.transform(df).collect())) == held[k]
        if k in ("ordinal", "label"):
            back = m.inverse_transform(m.transform(df))
            assert back.columns == df.columns and sorted(map(tuple, back.collect())) == rows


def test_imputers(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 4.0), (2, 5.0, float("nan")), (3, 5.0, 4.0)], "rid long, a double, b double")
    for strategy, want in (("mean", 11 / 3), ("median", 5.0), ("most_frequent", 5.0), ("constant", -1.0)):
        assert values(imputers.SimpleImputer(strategy, -1.0).fit_transform(df, ["a", "b"]), "a")[1] == pytest.approx(want)
    with pytest.raises(errors.AllMissing):
        imputers.SimpleImputer().fit(df.withColumn("a", F.lit(None).cast("double")), ["a"])
    near = imputers.KnnImputer(2).fit(df, ["a", "b"]).transform(df)
    # Row 1 is its own neighbour (distance 0), lacks a, and is left out; row 3 remains (Q14).
    assert values(near, "a")[1] == 5.0 and values(near, "b")[2] == 4.0


def test_fixed_box_cox_of_zero(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(i, float(i)) for i in range(5)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["power_fixed"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == [pytest.approx(r, abs=2e-6) for r in sorted(db.execute(queries.ORACLES["power_fixed"]).fetchall())]
    x = frame(spark, x=[0, 4])
    zero = scalers.PowerModel(["x"], [0.5], [0.0], [1.0], "box-cox", False, zero=True)
    assert values(zero.transform(x)) == [-2.0, 2.0] and values(zero.inverse_transform(zero.transform(x))) == [0.0, 4.0]
    for refused in (scalers.PowerModel(["x"], [0.5], [0.0], [1.0], "box-cox"), scalers.PowerModel(["x"], [0.0], [0.0], [1.0], "box-cox", zero=True)):
        with pytest.raises(Exception, match="must be positive"):
            refused.transform(x).collect()


@pytest.mark.parametrize("name", ["imputer_knn", "imputer_knn_distance"])
def test_knn_of_all_customers(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    got = {r["c_custkey"]: (r["bal"], r["nation"]) for r in queries.QUERIES[name](spark, folder).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
        want = {r[0]: r[1:] for r in db.execute(queries.ORACLES[name]).fetchall()}
    assert len(want) > 201 and got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-5) for i in want)


def test_knn_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    n, k = 5000, 4
    x = rng.integers(0, 12, (n, 3)).astype(float)  # many ties
    x[rng.random((n, 3)) < 0.04] = np.nan
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), *(None if np.isnan(v) else float(v) for v in r)) for i, r in zip(ids, x, strict=True)], "rid long, a double, b double, c double")
    got = {r["rid"]: r for r in imputers.KnnImputer(k).fit_transform(df.repartition(5), ["a", "b", "c"]).collect()}
    by_id = x[np.argsort(ids)]
    for i in np.flatnonzero(np.isnan(by_id).any(axis=1) & ~np.isnan(by_id).all(axis=1)):
        both = ~np.isnan(by_id[i]) & ~np.isnan(by_id)
        d = np.where(both, (by_id - by_id[i]) ** 2, 0).sum(axis=1) * (3 / np.maximum(both.sum(axis=1), 1))
        near = by_id[np.lexsort((np.arange(n), np.where(both.any(axis=1), d, np.inf)))[:k]]
        for j in np.flatnonzero(np.isnan(by_id[i])):
            seen = near[~np.isnan(near[:, j]), j]
            assert got[i]["abc"[j]] == (pytest.approx(seen.mean()) if len(seen) else None)
    assert len(got) == n


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_by_boxes(spark, monkeypatch, weights):
    from sparkloom.operators import distances

    rng = np.random.default_rng(11)
    n, k = 1500, 3
    x = np.stack([np.round(rng.uniform(-900, 9000, n), 2), rng.integers(0, 6, n), rng.normal(0, 3, n)], axis=1)
    x[:300] = x[300:600]  # copies, whose ids decide
    x[rng.random((n, 3)) < 0.15] = np.nan
    x[np.isnan(x).all(axis=1), 1] = 2.0
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), *(None if np.isnan(v) else float(v) for v in r)) for i, r in zip(ids, x, strict=True)], "rid long, a double, b double, c double")
    model = imputers.KnnImputer(k, weights).fit(df, ["a", "b", "c"])
    with monkeypatch.context() as changed:
        changed.setattr(distances, "LEAF", 60)
        changed.setattr(imputers, "_by_all_pairs", None)
        boxed = {r["rid"]: tuple(r) for r in model.transform(df).collect()}
    monkeypatch.setattr(imputers, "MOST_JOBS", 0)
    paired = {r["rid"]: tuple(r) for r in model.transform(df).collect()}
    assert len(boxed) == n and boxed.keys() == paired.keys()
    by_id = x[np.argsort(ids)]
    for i in range(n):
        both = ~np.isnan(by_id[i]) & ~np.isnan(by_id)
        d = np.where(both, (by_id - by_id[i]) ** 2, 0).sum(axis=1) * (3 / np.maximum(both.sum(axis=1), 1))
        near = np.lexsort((np.arange(n), np.where(both.any(axis=1), d, np.inf)))[:k]
        w = np.ones(k) if weights == "uniform" else 1 / np.maximum(d[near], 1e-12)
        for j in range(3):
            some = ~np.isnan(by_id[near, j])
            want = by_id[i, j] if not np.isnan(by_id[i, j]) else (by_id[near, j] * w)[some].sum() / w[some].sum() if some.any() else None
            assert boxed[i][j + 1] == (want if want is None else pytest.approx(want, rel=1e-9)) and paired[i][j + 1] == (want if want is None else pytest.approx(want, rel=1e-9))


def test_selection(spark):
    df = frame(spark, a=[1, 1, 5, 5], b=[1, 2, 1, 2], y=[0, 0, 1, 1])
    assert selection.f_classif(df, ["a", "b"], "y") == [math.inf, 0.0]
    assert selection.SelectKBest(1).fit(df, ["b", "a"], "y").kept == ["a"]
    assert selection.mutual_information(df, ["a"], "y") == pytest.approx([math.log(2)])
    assert selection.chi2(df, ["a"], "y") == pytest.approx([16 / 6 * 2])
    with pytest.raises(errors.InvalidConfig):
        selection.SelectKBest(3).fit(df, ["a", "b"], "y")
    with pytest.raises(errors.InvalidInput):
        selection.VarianceThreshold(10).fit(df, ["a"])


def known_linear(spark):
    i = np.arange(40)
    x = [np.sin(i), np.log(i + 7), 0.01 * np.exp(0.3 * i + 1)]
    return frame(spark, x0=x[0], x1=x[1], x2=x[2], y=2 * x[0] - 3.5 * x[1] + 5 * x[2] + 7)


def test_linear_models(spark):
    df = known_linear(spark)
    cols = ["x0", "x1", "x2"]
    m = linear.LinearRegression().fit(df, cols, "y")
    assert m.coef == pytest.approx([2, -3.5, 5], abs=1e-6) and m.intercept == pytest.approx(7, abs=1e-6) and m.score(df, "y") == pytest.approx(1)
    assert linear.Ridge(alpha=0.0).fit(df, cols, "y").coef == pytest.approx(m.coef, abs=1e-5)
    assert np.linalg.norm(linear.Ridge(alpha=50.0).fit(df, cols, "y").coef) < np.linalg.norm(m.coef)
    assert linear.Lasso(alpha=1e9).fit(df, cols, "y").coef == [0, 0, 0]
    twin = df.withColumn("x3", F.col("x0"))
    with pytest.raises(errors.Singular):
        linear.LinearRegression().fit(twin, ["x0", "x3"], "y")
    assert linear.LinearRegression(solver="svd").fit(twin, ["x0", "x3"], "y").coef[0] == pytest.approx(linear.LinearRegression().fit(df, ["x0"], "y").coef[0] / 2)


def test_logistic(spark):
    x = [0.5 * i for i in range(-5, 6) if i]
    m = linear.LogisticRegression(max_iter=15).fit(frame(spark, x=x, y=[float(v > 0) for v in x]), ["x"], "y")
    assert m.score(frame(spark, x=x, y=[float(v > 0) for v in x]), "y") == 1
    pts = [(-5.0, -5.0, 0.0)] * 15 + [(0.0, 5.0, 2.0)] * 15 + [(5.0, -5.0, 7.0)] * 15
    df = frame(spark, a=[p[0] for p in pts], b=[p[1] for p in pts], y=[p[2] for p in pts])
    three = linear.LogisticRegression(max_iter=25).fit(df, ["a", "b"], "y")
    assert three.classes == [0, 2, 7] and three.score(df, "y") == 1
    assert three.predict_proba(df).select(F.aggregate("probability", F.lit(0.0), lambda p, r: p + r).alias("s")).first()["s"] == pytest.approx(1)
    # The binary intercept is the base rate's logit less mean * beta (Q9).
    rng = np.random.default_rng(0)
    xs = rng.normal(2, 1, 200)
    ys = (rng.random(200) < 1 / (1 + np.exp(1 - xs))).astype(float)
    b = linear.LogisticRegression().fit(frame(spark, x=xs, y=ys), ["x"], "y")
    assert b.intercept[0] == pytest.approx(math.log(ys.mean() / (1 - ys.mean())) - xs.mean() * b.coef[0][0])


def test_small_systems():
    a = np.array([[4.0, 2.0], [2.0, 3.0]])
    assert cholesky_solve(a, np.array([2.0, 1.0])) == pytest.approx(np.linalg.solve(a, [2, 1]))
    with pytest.raises(errors.Singular):
        cholesky_solve(np.ones((2, 2)), np.ones(2))
    assert pinv_solve(np.ones((2, 2)), np.ones(2)) == pytest.approx([0.5, 0.5])


def test_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 10)) @ rng.normal(size=(10, 10))
    cols = [f"c{i}" for i in range(10)]
    df = frame(spark, **{c: x[:, i] for i, c in enumerate(cols)})
    m = decomposition.PCA(None).fit(df, cols)
    assert m.explained_variance == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1].tolist())
    back = m.inverse_transform(m.transform(df))
    assert values(back, "c3") == pytest.approx(x[:, 3].tolist())
    r = decomposition.PCA(3, solver="randomized").fit(df, cols)
    assert r.explained_variance == pytest.approx(m.explained_variance[:3], rel=1e-3)
    s = decomposition.TruncatedSVD(2).fit(df, cols)
    assert s.singular_values == pytest.approx(np.linalg.svd(x)[1][:2].tolist())
    with pytest.raises(errors.InvalidConfig):
        decomposition.TruncatedSVD(11).fit(df, cols)


def test_kmeans_and_silhouette(spark):
    pts = [(20.0 * b + d, 20.0 * b) for b in range(3) for d in (-1, 0, 1)]
    df = frame(spark, a=[p[0] for p in pts], b=[p[1] for p in pts])
    m = cluster.KMeans(3, n_init=3).fit(df, ["a", "b"])
    labels = values(m.transform(df), "cluster")
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 3])) == 1 for i in (0, 3, 6)) and m.inertia == pytest.approx(6)
    assert cluster.silhouette_score(m.transform(df), ["a", "b"], "cluster") > 0.9
    with pytest.raises(errors.InvalidInput):
        cluster.KMeans(20).fit(df, ["a", "b"])


def test_kmeans_starts_share_passes(spark, monkeypatch):
    passes, real = [], cluster._assigned
    monkeypatch.setattr(cluster, "_assigned", lambda *a: passes.append(1) or real(*a))
    df = frame(spark, a=[i % 3 * 100 + i for i in range(30)], b=[i % 3 * 50 for i in range(30)])
    m = cluster.KMeans(3, n_init=3, max_iter=4, tol=0.0).fit(df, ["a", "b"])
    assert len(passes) <= 4 and sorted(m.centres) == [pytest.approx(c) for c in ([13.5, 0], [114.5, 50], [215.5, 100])]


def test_silhouette_of_all_customers(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    got = {r["rid"]: r["silhouette"] for r in queries.QUERIES["silhouette"](spark, folder).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
        want = dict(db.execute(queries.ORACLES["silhouette"]).fetchall())
    assert len(want) > 401 and got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def test_silhouette_of_many_rows(spark):
    n = 20_500
    df = spark.range(n).select(F.col("id").alias("rid"), (F.col("id") % 2).alias("k"), (F.col("id") % 2 * 10.0).alias("a"))
    assert cluster.silhouette_samples(df, ["a"], "k").agg(F.count("*"), F.min("silhouette"), F.max("silhouette")).first() == (n, 1.0, 1.0)


@pytest.mark.parametrize("shape", ["plane", "line", "clumps", "deep", "space"])
def test_silhouette_by_boxes(spark, monkeypatch, shape):
    from sparkloom.operators import distances

    rng = np.random.default_rng(7)
    n = 3000
    x = np.round(np.stack([rng.uniform(-900, 9000, n), rng.integers(0, 25, n), rng.normal(0, 50, n)], axis=1), 2)
    if shape == "line":
        x[:, 1:] = 3.0
    elif shape == "clumps":
        x[: n // 2] = np.round(x[: n // 2] / 3000) * 3000  # many copies
    elif shape == "deep":
        x[:, 0] = 1e6 * 2.0 ** -rng.integers(0, 40, n) + rng.uniform(0, 1e-7, n)
    cols = ["a", "b", "c"] if shape in ("line", "space") else ["a", "b"]
    own = rng.integers(0, 4, n)
    own[0] = 4  # alone
    monkeypatch.setattr(distances, "LEAF", 40)
    if shape != "space":
        monkeypatch.setattr(cluster, "sweep", None)  # not all pairs
    df = spark.createDataFrame([(i, f"k{k}", *map(float, r)) for i, (k, r) in enumerate(zip(own, x, strict=True))], "rid long, k string, a double, b double, c double")
    got = dict(tuple(r) for r in cluster.silhouette_samples(df, cols, "k").collect())
    d = np.sqrt(((x[:, None, : len(cols)] - x[None, :, : len(cols)]) ** 2).sum(axis=2))
    sums, sizes, rows = np.stack([d[:, own == k].sum(axis=1) for k in range(5)], axis=1), np.bincount(own), np.arange(n)
    a, b = sums[rows, own] / np.maximum(sizes[own] - 1, 1), np.where(np.arange(5) == own[:, None], np.inf, sums / sizes).min(axis=1)
    want = np.where(sizes[own] > 1, (b - a) / np.maximum(a, b), 0.0)
    assert len(got) == n and max(abs(got[i] - want[i]) for i in range(n)) < 1e-12


def test_metrics(spark):
    df = frame(spark, y=[3, -0.5, 2, 7], p=[2.5, 0, 2, 8])
    r = metrics.regression_metrics(df, "y", "p").first()
    assert (r["mse"], r["mae"], r["max_error"]) == (0.375, 0.5, 1.0) and r["r2"] == pytest.approx(0.9486081370449679)
    c = metrics.Classification.of(frame(spark, y=[0, 0, 1, 1, 2], p=[0, 1, 1, 1, 0]), "y", "p")
    assert c.accuracy() == pytest.approx(0.6) and c.of_class(2.0) == (0, 0, 0) and c.scores("micro")[0] == c.accuracy()
    with pytest.raises(errors.InvalidInput):
        c.scores("macro", zero="error")
    s = frame(spark, y=[0, 0, 1, 1], s=[0.1, 0.4, 0.35, 0.8])
    assert metrics.roc_auc_score(s, "y", "s") == 0.75 and metrics.average_precision_score(s, "y", "s") == pytest.approx(0.8333333)
    assert metrics.log_loss(s, "y", "s") == pytest.approx(-(math.log(0.9) + math.log(0.6) + math.log(0.35) + math.log(0.8)) / 4)


def test_splits(spark):
    df = frame(spark, x=list(range(23)), y=[float(i % 3) for i in range(23)])
    train, test = splits.train_test_split(df, 0.25, seed=7)
    assert test.count() == 6 and train.join(test, "rid", "left_semi").count() == 0
    assert sorted(r["count"] for r in splits.KFold(5, True, 3).assign(df).groupBy("fold").count().collect()) == [4, 4, 5, 5, 5]
    assert splits.StratifiedKFold(4).assign(df, "y").groupBy("fold").count().count() == 4
    rng = splits.Xorshift(1)
    assert rng.next() == (1 ^ (1 << 13)) ^ ((1 ^ (1 << 13)) >> 7) ^ (((1 ^ (1 << 13)) ^ ((1 ^ (1 << 13)) >> 7)) << 17)
    assert sorted(splits.Xorshift(9).permutation(50)) == list(range(50))


def test_composition_and_storage(spark, tmp_path, cities):
    ct = compose.ColumnTransformer([("num", scalers.MinMaxScaler(), ["y"]), ("cat", encoders.OneHotEncoder(), ["c"])], ["y"], ["c"], keep=["rid"])
    m = ct.fit(cities)
    assert m.transform(cities).columns == ["rid", "y", "c_", "c_x", "c_y"]
    with pytest.raises(errors.NotFitted):
        compose.ColumnTransformer([("t", encoders.TargetEncoder(), ["c"])], [], ["c"]).fit(cities)
    p = compose.Pipeline([("a", scalers.StandardScaler()), ("b", scalers.MinMaxScaler())]).fit(frame(spark, x=[1, 2, 4]), ["x"])
    save_model(spark, p, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    df = frame(spark, x=[1, 2, 4])
    assert values(again.transform(df)) == values(p.transform(df)) == pytest.approx([0, 1 / 3, 1])
    with pytest.raises(errors.InvalidInput):
        Model.from_json(scalers.StandardScaler().fit(df, ["x"]).to_json().replace('"scale": [', '"scale": [1, '))
    with pytest.raises(errors.InvalidConfig):
        compose.Pipeline().fit(df, ["x"])


def test_models_on_streams(spark, tmp_path):
    df = frame(spark, x=[1, 2, 4])
    df.write.parquet(str(tmp_path / "in"))
    m = scalers.MaxAbsScaler().fit(df, ["x"])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    transform_stream(stream, m, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out"))) == [0.25, 0.5, 1]


def test_matrix_surface(spark):
    m = matrix.from_rows(spark, [[1, 2], [3, 4]], ["a", "b"])
    assert matrix.cell(m, 1, "a") == 3 and matrix.row(m, 0, ["a", "b"]) == [1, 2] and values(matrix.column(m, "b"), "value") == [2, 4]
    assert sorted(map(tuple, matrix.transposed_cells(m, ["a", "b"]).collect())) == [(0, 0, 1), (0, 1, 3), (1, 0, 2), (1, 1, 4)]
    assert values(matrix.zeros(spark, 3, ["z"]), "z") == [0, 0, 0] and [tuple(r) for r in matrix.identity(spark, ["a", "b"]).orderBy("rid").collect()] == [(0, 1, 0), (1, 0, 1)]
    for wrong in (lambda: matrix.from_rows(spark, [], ["a"]), lambda: matrix.cell(m, 9, "a"), lambda: matrix.cell(m, 0, "q"), lambda: matrix.zeros(spark, 0, ["a"]), lambda: matrix.row(m, 9, ["a"])):
        with pytest.raises(errors.ShapeMismatch):
            wrong()
    s = matrix.from_triplets(spark.createDataFrame([(0, 1, 2.0), (0, 3, 5.0)], "row long, col long, value double"), 4)
    assert matrix.sparse_get(s, 0, 3) == 5 and matrix.sparse_get(s, 0, 0) == 0 and matrix.row_nz(s, 0) == [(1, 2.0), (3, 5.0)] and matrix.row_nz(s, 7) == []


def test_many_references(spark):
    rng = np.random.default_rng(6)
    xs = np.round(rng.normal(size=300), 1).tolist()  # ties
    m = scalers.QuantileTransformer(250).fit(frame(spark, x=xs), ["x"])
    refs = m.references[0]
    new = [*np.round(rng.normal(size=200), 2).tolist(), *refs[::40], -99, 99]
    for x, got in zip(new, values(m.transform(frame(spark, x=new))), strict=True):
        i = next((i for i in range(249) if refs[i] <= x < refs[i + 1]), None)
        want = 0 if x <= refs[0] else 1 if x >= refs[-1] else (i + (x - refs[i]) / (refs[i + 1] - refs[i])) / 249
        assert got == pytest.approx(want)


def test_associations_in_one_pass(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y", " NA "]), rng.choice("pqr"), rng.random(), rng.random() * i) for i in range(300)]
    df = spark.createDataFrame(rows, "rid long, b string, c string, d string, u double, v double")
    found = {(a.kind, a.left, a.right): a.value for a in profile.associations(df, {"u": F.col("u"), "v": F.col("v")}, ["b", "c", "d"], "rid")}
    assert {k[1:] for k in found if k[0] == "cramers_v"} == {("b", "c"), ("b", "d"), ("c", "d")} and {k[1:] for k in found if k[0] == "point_biserial"} == {(c, v) for c in "bc" for v in "uv"}
    first = next(r[1] for r in rows)
    assert found["point_biserial", "b", "u"] == pytest.approx(np.corrcoef([r[1] != first for r in rows], [r[4] for r in rows])[0, 1])
    whole = [(r[2], r[3]) for r in rows if r[2] != " NA "]
    table = np.array([[sum(p == (x, y) for p in whole) for y in "pqr"] for x in "xy"], dtype=float)
    expected = table.sum(1)[:, None] * table.sum(0)[None, :] / table.sum()
    assert found["cramers_v", "c", "d"] == pytest.approx(math.sqrt(((table - expected) ** 2 / expected).sum() / len(whole)))


def test_rows_are_numbered_without_a_folder(spark):
    numbered = stats.with_rid(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k long"), ["k"])
    assert [r["rid"] for r in numbered.orderBy("k").collect()] == list(range(50)) and "Window" not in numbered._jdf.queryExecution().toString()
    with pytest.raises(errors.InvalidInput):
        splits.StratifiedKFold(2).assign(spark.createDataFrame([(0, None), (1, 1.0), (2, 1.0)], "rid long, y double"), "y")


def test_profile(spark):
    rows = [(0, "1", "red", 1.0), (1, " NA ", "blue", 1.0), (2, "3", "red", 1.0), (3, "3", "red", None)]
    p = profile.profile(spark.createDataFrame(rows, "rid long, n string, c string, k double"), ["k"], ["n", "c"], rid="rid")
    assert p.column("n").column_type == "numeric" and p.column("n").missing_count == 1 and p.column("c").categorical.top == "red"
    kinds = {(f.kind, f.column) for f in profile.run_checks(p)}
    assert ("ConstantColumn", "k") in kinds and ("NearUnique", "c") not in kinds
    assert '"findings"' in report.to_json(p) and "<html>" in report.to_html(p) and "red" in report.to_html(p)
    assert profile.histogram_edges(1, 2.0, 2.0) == [2.0, 2.0] and profile.sturges_bins(8) == 4
    assert report.number(1e6) == "1.000e+06" and report.number(None) == "—" and report.number(0.5) == "0.5000"
    with pytest.raises(errors.EmptyInput):
        profile.profile(spark.createDataFrame([], "a double"), ["a"], [])


def test_duplicates_and_sparse(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (None, "b"), (None, "b")], "x double, s string")
    assert stats.duplicate_rows(df, ["x"], ["s"]).first()["duplicates"] == 1
    tr = spark.createDataFrame([(0, 1, 2.0), (0, 1, -2.0), (0, 2, 3.0), (1, 0, 1.0)], "row long, col long, value double")
    dense = {r["row"]: list(r["values"]) for r in matrix.to_dense(matrix.from_triplets(tr, 3)).collect()}
    assert dense == {0: [0, 0, 3.0], 1: [1.0, 0, 0]}
    numbered = stats.with_rid(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k long"), ["k"])
    assert [r["rid"] for r in numbered.orderBy("k").collect()] == list(range(50))
