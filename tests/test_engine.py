"""Catalogue, expressions, operators against NumPy, and the search parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import metrics
from chronoweave.functions.catalogue import Catalogue, Family
from chronoweave.plans.compiler import SeriesFrame
from chronoweave.plans.expression import Call, Const, Mutator, Var, grow, grow_full, leaf, parse
from chronoweave.search import models
from chronoweave.search.annealing import AnnealingSchedule, FeatureSearch, ols_scorer
from chronoweave.search.discovery import Discovery, Settings
from chronoweave.search.guards import OverfittingGuard, inflation_factors, rolling_r2
from chronoweave.search.scoring import DualScorer, Mlp, expanding_cuts, expanding_splits, guard_cuts, guard_splits, mlp_scores, ols_scores
from chronoweave.sources.datasets import DatasetLoader

C = Catalogue(seed=42)


def test_catalogue(spark):
    assert C.num_operators == 373
    assert C.summary() == {"arithmetic": 12, "statistical": 28, "cross_sectional": 15, "rolling_window": 318}
    assert len({o.name for o in C.operators}) == 373
    assert len(C.by_base_name("ts_mean")) == 6 and C.get("ts_mean_21").window == 21
    assert all(o.arity == 2 for o in C.sample_n(20, family=Family.ROLLING_WINDOW, arity=2))
    assert len({o.name for o in C.sample_n(12, family=Family.ARITHMETIC, replace=False)}) == 12
    with pytest.raises(ValueError):
        C.sample(arity=7)
    assert C.to_df(spark).groupBy("family").count().count() == 4


def test_public_names():
    import chronoweave

    assert all(hasattr(chronoweave, n) for n in chronoweave.__all__) and chronoweave.Catalogue is Catalogue
    with pytest.raises(AttributeError):
        chronoweave.nothing


def test_expressions():
    rng = random.Random(1)
    for i in range(50):
        t = grow(C, ["close", "volume"], rng=rng)
        assert 1 <= t.depth() <= 4 and parse(str(t)) == t
    full = grow_full(C, ["close"], 3, rng=rng)
    assert full.depth() == 3
    a, b = (grow(C, ["x", "y"], rng=random.Random(5)) for _ in range(2))
    assert a == b
    m = Mutator(C, ["x", "y", "z"], seed=3)
    for _ in range(200):
        a = m.mutate(a)
        assert a.depth() <= 4
    twin = Call("add", (Var("x"), Var("x"))).replace((1,), Var("y"))
    assert str(twin) == "add(x, y)"
    for bad in ("add(x)", "nope(x)", "add(x, y", "add(x,, y)", "add(x, y) z"):
        with pytest.raises(ValueError):
            parse(bad)
    assert parse("`odd name`") == Var("odd name")


def series(seed=0, n=60):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n).round(3), rng.normal(size=n).round(3)
    a[[0, 7, 8, 20]] = np.nan
    b[[3, 7, 21]] = np.nan
    a[30:36] = a[30]
    return a, b


def run(spark, calls, a, b, parts=3, root=False):
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    rows += [(2, i, 1.0, 2.0) for i in range(4)]  # another series, shorter than any window
    df = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), "k int, t int, a double, b double").repartition(parts)
    out = SeriesFrame(df, ("k",), ("t",)).with_features(calls, root=root)
    got = out.toPandas().sort_values(["k", "t"])
    assert (got[got.k == 2][[c for c in calls if c.startswith("ts_") and "ema" not in c]] == 0).all().all()
    return got[got.k == 1]


def frames(w, f, *xs):
    out = []
    for i in range(len(xs[0])):
        chunk = [x[i - w + 1 : i + 1] for x in xs]
        if i < w - 1 or any(np.isnan(c).all() for c in chunk):
            out.append(0.0)
            continue
        with np.errstate(all="ignore"):
            v = f(*chunk)
        out.append(v if np.isfinite(v) else 0.0)
    return np.array(out)


def cov(c, d):
    return np.nanmean((c - np.nanmean(c)) * (d - np.nanmean(d)))


@pytest.mark.filterwarnings("ignore")
def test_rolling_with_missing(spark):
    a, b = series()
    w = 10
    decay = np.arange(1, w + 1) / np.arange(1, w + 1).sum()
    want = {
        "ts_mean": lambda c: np.nanmean(c),
        "ts_std": lambda c: np.nanstd(c, ddof=1),
        "ts_rank": lambda c: np.sum(c <= c[-1]) / w,
        "ts_decay_linear": lambda c: np.nansum(c * decay),
        "ts_median": np.nanmedian,
        "ts_argmax": lambda c: float(np.nanargmax(c)),
        "ts_argmin": lambda c: float(np.nanargmin(c)),
        "ts_maxdrawdown": lambda c: np.nanmax(np.maximum.accumulate(c) - c),
        "ts_autocorr": lambda c: np.nanmean((c - np.nanmean(c))[:-1] * (c - np.nanmean(c))[1:]) / np.nanvar(c),
        "ts_mad": lambda c: np.nanmean(np.abs(c - np.nanmean(c))),
        "ts_iqr": lambda c: np.nanquantile(c, 0.75) - np.nanquantile(c, 0.25),
        "ts_cumprod": lambda c: np.nanprod(np.clip(c, -1e4, 1e4)),
        "ts_count_negative": lambda c: float(np.nansum(c < 0)),
        "ts_zscore": lambda c: (c[-1] - np.nanmean(c)) / np.nanstd(c),
    }
    two = {
        "ts_cov": cov,
        "ts_corr": lambda c, d: cov(c, d) / (np.nanstd(c) * np.nanstd(d)),
        "ts_regression": lambda c, d: cov(c, d) / np.nanvar(d),
        "ts_granger": lambda c, d: np.corrcoef(c[1:], d[:-1])[0, 1],
        "ts_tracking_error": lambda c, d: np.nanstd(c - d, ddof=1),
        "ts_cosine_sim": lambda c, d: np.nansum(c * d) / (math.sqrt(np.nansum(c * c)) * math.sqrt(np.nansum(d * d))),
        "ts_dtw": lambda c, d: np.nanmean(np.abs(c - d)),
    }
    calls = {n: f"{n}_{w}(a)" for n in want} | {n: f"{n}_{w}(a, b)" for n in two}
    got = run(spark, calls, a, b)
    for n, f in want.items():
        np.testing.assert_allclose(got[n], frames(w, f, a), atol=1e-9, err_msg=n)
    for n, f in two.items():
        np.testing.assert_allclose(got[n], frames(w, f, a, b), atol=1e-9, err_msg=n)


@pytest.mark.filterwarnings("ignore")
def test_whole_series_with_missing(spark):
    """All operators over a whole series, with holes, after a constant column, and with no
    value at all."""
    mean, sd, q = np.nanmean, np.nanstd, np.nanquantile
    eps = 1e-10

    def scaled(top, width):
        return top / width if width >= eps else np.zeros(len(top))

    def moment(x, k, less):
        return np.nanmean((x - mean(x)) ** k) / sd(x) ** k - less if sd(x) >= eps else 0.0

    def over(x, spread):
        return mean(x) / spread if spread > eps else 0.0

    def order(x):
        return np.argsort(np.argsort(np.nan_to_num(x), kind="stable"), kind="stable").astype(float)

    def slope(x, y):
        return cov(x, y) / np.nanvar(y) if np.nanvar(y) >= eps else 0.0

    def change(x):
        back = np.r_[np.nan, x[:-1]]
        return np.nan_to_num((x - back) / (np.abs(back) + eps))

    one = {
        "mean": mean, "median": np.nanmedian, "std": sd, "var": np.nanvar, "iqr": lambda x: q(x, 0.75) - q(x, 0.25), "mad": lambda x: mean(np.abs(x - mean(x))),
        **{f"quantile_{k}": lambda x, k=k: q(x, k / 100) for k in (10, 25, 75, 90)},
        "skew": lambda x: moment(x, 3, 0), "kurtosis": lambda x: moment(x, 4, 3),
        "zscore": lambda x: scaled(x - mean(x), sd(x)), "min_max_scale": lambda x: scaled(x - np.nanmin(x), np.nanmax(x) - np.nanmin(x)), "robust_scale": lambda x: scaled(x - np.nanmedian(x), q(x, 0.75) - q(x, 0.25)),
        "sharpe": lambda x: over(x, sd(x)), "sortino": lambda x: over(x, sd(x[x < 0])) if (x < 0).any() else 0.0,
        "max_drawdown": lambda x: np.maximum.accumulate(np.nan_to_num(x)) - x,
        "cumsum": np.nancumsum, "cumprod": lambda x: np.cumprod(np.where(np.isnan(x), 1, x)),
        "cummax": lambda x: np.maximum.accumulate(np.where(np.isnan(x), -np.inf, x)), "cummin": lambda x: np.minimum.accumulate(np.where(np.isnan(x), np.inf, x)),
        "pct_change": change, "rank": order, "percentile": lambda x: order(x) / (len(x) - 1), "rank_pct": lambda x: order(x) / (len(x) - 1),
        "demean": lambda x: x - mean(x), "zscore_cs": lambda x: scaled(x - mean(x), sd(x)),
        **{n: lambda x: x / np.nansum(np.abs(x)) if np.nansum(np.abs(x)) > eps else np.zeros(len(x)) for n in ("normalize", "scale")},
        "winsorize": lambda x: np.clip(x, q(x, 0.01), q(x, 0.99)), "cs_max": np.nanmax, "cs_min": np.nanmin, "cs_mean": mean, "cs_std": sd, "cs_median": np.nanmedian, "cs_sum": np.nansum, "cs_count_positive": lambda x: np.sum(x > 0),
    }
    two = {
        "information_ratio": lambda x, y: over(x - y, sd(x - y)),
        "corr": lambda x, y: cov(x, y) / (sd(x) * sd(y)) if sd(x) >= eps and sd(y) >= eps else 0.0,
        "cov": cov,
        "beta": slope,
        "residual": lambda x, y: x - slope(x, y) * y - (mean(x) - slope(x, y) * mean(y)) if np.nanvar(y) >= eps else x,
    }
    assert len(one) + len(two) == sum(o.family.name in ("STATISTICAL", "CROSS_SECTIONAL") for o in C.operators)
    calls = {n: f"{n}(a)" for n in one} | {n: f"{n}(a, b)" for n in two}
    a, b = series(4)
    flat = np.where(np.isnan(a), np.nan, 2.5)
    for x, y in ((a, b), (flat, b), (a, flat), (np.abs(a) + 1, b)):
        got = run(spark, calls, x, y)
        for n, f in [*one.items(), *((n, lambda x, f=f: f(x, y)) for n, f in two.items())]:
            np.testing.assert_allclose(got[n].to_numpy(float), np.broadcast_to(f(x), len(x)), atol=1e-9, err_msg=n)
    # Without any value there is nothing but 0 or a missing value, which the root makes 0.
    got = run(spark, calls, np.full(9, np.nan), b[:9], root=True)
    rest = got[[n for n in calls if n not in ("rank", "percentile", "rank_pct", "cumprod", "cummax", "cummin")]]
    assert (rest == 0).all().all() and (got["cumprod"] == 1).all() and (got["cummax"] == -1e9).all() and (got["cummin"] == 1e9).all() and got["rank"].tolist() == list(range(9))


def test_recursive_and_guards(spark):
    x = np.random.default_rng(1).normal(size=3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, a double")
    out = SeriesFrame(df, (), ("t",)).with_features({f"e{w}": f"ts_ema_{w}(a)" for w in (5, 252)}).toPandas().sort_values("t")
    for w in (5, 252):
        e, alpha = [x[0]], 2 / (w + 1)
        for v in x[1:]:
            e.append(alpha * v + (1 - alpha) * e[-1])
        np.testing.assert_allclose(out[f"e{w}"], e, atol=1e-10)
    a = np.array([1.0, 0.0, -2.0, 1e-10, np.inf, np.nan, 1e12])
    got = run(spark, {"div": "div(a, b)", "log": "log(a)", "sqrt": "sqrt(a)", "exp": "exp(a)", "clip": "clip(a)", "mul": "mul(a, a)"}, a, np.array([0.0, 1, 2, 1, 1, 1, 1]), root=True)
    assert got["div"].tolist() == [0, 0, -1, 1e-10, 0, 0, 1e9]
    assert got["log"].tolist()[:4] == [0, 0, 0, 0] and got["mul"].tolist()[4:] == [1e9, 0, 1e9]
    assert np.isfinite(got[["div", "log", "sqrt", "exp", "clip", "mul"]]).all().all()
    with pytest.raises(ValueError):
        SeriesFrame(df, (), ("t",)).with_features({"f": "abs(zzz)"})
    assert SeriesFrame(df, (), ("t",)).with_features({"f": "abs(zzz)"}, missing="zero").agg(F.sum("f")).first()[0] == 0
    empty = SeriesFrame(df.limit(0), (), ("t",)).with_features({"f": "ts_corr_5(a, ts_mean_5(a))"})
    assert empty.count() == 0


def test_no_look_ahead(spark):
    a, b = series(3)
    calls = {o.base_name: f"{o.base_name}_5({'a' if o.arity == 1 else 'a, b'})" for o in C.operators if o.window == 5}
    whole, part = run(spark, calls, a, b), run(spark, calls, a[:40], b[:40], parts=1)
    np.testing.assert_allclose(whole[list(calls)].to_numpy(float)[:40], part[list(calls)].to_numpy(float), atol=1e-9)


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(42)
    f, noise = rng.normal(size=500), rng.normal(size=(500, 3))
    rows = [(i, float(f[i]), float(2 * f[i] + 0.1 * noise[i, 0]), float(noise[i, 1]), float(f[i] + 1e-3 * noise[i, 2]), float(f[i] ** 2 + 0.1 * noise[i, 0])) for i in range(500)]
    return spark.createDataFrame(rows, "t int, f double, y double, junk double, twin double, sq double").cache()


def test_scores(signal):
    assert expanding_splits(60) == [] and expanding_splits(65) == [(63, 65)] and len(expanding_splits(500)) == 5
    got = {r["feature"]: r["score"] for r in ols_scores(signal, ["f", "junk"], "y", (), ("t",)).collect()}
    assert got["f"] > 0.5 and got["junk"] < 0.3
    f, y = (np.array([r[0] for r in signal.orderBy("t").select(c).collect()]) for c in ("f", "y"))
    parts = []
    for end, stop in expanding_splits(500):
        k, c = np.polyfit(f[:end], y[:end], 1)
        e, n = y[end:stop] - k * f[end:stop] - c, stop - end
        parts.append(1 - (e @ e) / ((y[end:stop] - y[end:stop].mean()) ** 2).sum() - 0.01 * (n * math.log(e @ e / n) + 2 * math.log(n)) / n)
    assert got["f"] == pytest.approx(np.mean(parts), abs=1e-9)
    net = mlp_scores(signal, ["f"], "sq", (), ("t",)).first()["score"]
    assert net > 0
    ranked = DualScorer(top=1).score_batch(signal, ["junk", "f"], "y", (), ("t",))
    assert [n for n, _ in ranked] == ["f"]
    x = np.linspace(-1, 1, 300)[:, None]
    assert np.array_equal(Mlp(seed=1).fit(x, x[:, 0]).predict(x), Mlp(seed=1).fit(x, x[:, 0]).predict(x))


def test_guard(signal):
    v = inflation_factors(signal, ["f", "twin", "junk"])
    assert v["f"] > 100 and v["junk"] < 1.1
    guard = OverfittingGuard(stability_factor=100.0)
    assert guard.filter(signal, ["f", "twin", "junk"], "y", (), ("t",)) == ["twin"] or guard.removed["f"] == "vif"
    assert guard.removed["junk"] == "validation"
    assert OverfittingGuard().filter(signal, ["f", "junk"], "y", (), ("t",)) == []  # the default rule passes few


def test_stability_of_series_of_unequal_length(spark, signal):
    guard = OverfittingGuard(window=60)
    rows = signal.withColumn("s", F.when(F.col("t") < 300, "a").when(F.col("t") < 480, "b").otherwise("short"))
    # The short series has no vote; the others have windows of 60 rows, as if alone.
    assert guard._stable(rows, ["f", "junk"], "y", ["s"], ["t"]) == guard._stable(rows.filter("s <> 'short'"), ["f", "junk"], "y", ["s"], ["t"]) == []
    assert guard._stable(rows.filter("s = 'short'"), ["f"], "y", ["s"], ["t"]) == ["f"]
    # Each series by its own window, held against rolling_r2.
    mixed = rows.withColumn("s", F.when(F.col("t") < 400, "a").when(F.col("t") < 465, "b").otherwise("c"))
    for factor in (3.0, 4.0, 5.0, 6.0):
        votes = []
        for s, window in (("a", 60), ("b", 21), ("c", 11)):
            r = [x.r2 for x in rolling_r2(mixed.filter(F.col("s") == s), "junk", "y", [], ["t"], window).collect()]
            votes.append(max(r) - min(r) <= factor * np.std(r, ddof=1) + 1e-15)
        got = OverfittingGuard(window=60, stability_factor=factor)._stable(mixed, ["junk"], "y", ["s"], ["t"])
        assert got == (["junk"] if sum(votes) > 1.5 else [])


def test_trees_predict_rows_with_missing_features(spark, signal):
    holes = signal.withColumn("f", F.when(F.col("t") % 10 == 0, None).when(F.col("t") % 10 == 1, math.nan).otherwise(F.col("f")))
    fit = models.create("gbt", trees=3, depth=2).fit(holes, ["f"], "y")
    got = fit.predict(holes)
    assert got.count() == 500 and got.filter("prediction is null or isnan(prediction)").count() == 0


def test_search(spark):
    s = AnnealingSchedule(1.0, 200, seed=1)
    assert s.temperature(0) == 1 and s.temperature(200) <= 0.01 and s.temperature(100) == 0.5
    assert s.metropolis_accept(0.1, 1.0) and not s.metropolis_accept(math.nan, 1.0)
    assert sum(s.metropolis_accept(-0.5, 0.001) for _ in range(100)) < 10
    scorer = lambda trees: [-abs(t.size() - 5) for t in trees]
    found = FeatureSearch(C, ["x"], pool=40, elites=8, iterations=15, seed=1).search(scorer, 5)
    again = FeatureSearch(C, ["x"], pool=40, elites=8, iterations=15, seed=1).search(scorer, 5)
    assert found.pool == again.pool and found.pool[0][1] == 0 and {h[3] for h in found.history} == {40}
    df = spark.range(200).select(F.col("id").alias("t"), F.sin(F.col("id") / 5).alias("x"), F.cos(F.col("id") / 5).alias("y"))
    scores = ols_scorer(SeriesFrame(df, (), ("t",)), "y")([parse("ts_delta_5(x)"), parse("abs(nope)")])
    assert math.isfinite(scores[0]) and scores[1] == -math.inf


def test_discovery(spark, tmp_path):
    (tmp_path / "settings.json").write_text('{"pool": 12, "elites": 3, "iterations": 2, "max_depth": 2, "candidates": 6, "features": 3, "top": 3, "stability_factor": 100, "look_ahead": false}')
    settings = Settings.read(str(tmp_path / "settings.json"))
    assert settings.stability_factor == 100.0 and Settings().pool == 500 and Settings().features == 30
    for bad in ({"nope": 1}, {"pool": 1.5}, {"network": 1}, {"alpha": "x"}):
        with pytest.raises(ValueError):
            Settings.of(bad)
    df = spark.range(600).select(F.col("id").alias("t"), F.sin(F.col("id") / 9).alias("x"), F.randn(3).alias("z"))
    df = SeriesFrame(df, (), ("t",)).with_features({"y": "add(ts_mean_5(x), mul(z, 0.1))"}).cache()
    discovery = Discovery(settings, seed=3)
    assert not any(o.uses_future for o in discovery.catalogue.operators)
    found = discovery.find(df, ["x", "z"], "y", (), ("t",))
    assert 0 < len(found.features) <= 3 and all(math.isfinite(v) for v in found.scores.values())
    assert set(found.removed.values()) <= {"vif", "stability", "validation"} and not set(found.removed) & set(found.features.values())
    # Rows kept back decide nothing.
    wild = df.withColumn("y", F.when(F.col("t") < 480, F.col("y")).otherwise(1e6))
    assert discovery.find(wild, ["x", "z"], "y", (), ("t",)).features == found.features
    found.to_df(spark).write.json(str(tmp_path / "found"))
    again = {r.feature: parse(r.expr) for r in spark.read.json(str(tmp_path / "found")).collect()}
    assert again == found.features
    table, test = discovery.compare(df, {"m": "ts_mean_5(x)"}, ["z"], "y", (), ("t",), trees=10, depth=3)
    by = {r["columns"]: r for r in table.collect()}
    assert by["features"].mae < by["raw"].mae and test.preferred == "model_b"


def test_metrics_and_models(spark, signal):
    same = spark.createDataFrame([(i, float(i), float(i), float(i) + (i % 3), float(i) - (i % 2)) for i in range(1, 60)], "t int, y double, p double, q double, r double")
    assert metrics.errors(same, "y", "p").first().asDict() == {"mae": 0.0, "rmse": 0.0, "mape": 0.0}
    assert metrics.diebold_mariano(same, "y", "q", "q", ("t",)).p_value == 1.0
    assert metrics.diebold_mariano(same, "y", "p", "q", ("t",)).preferred == "model_a"
    assert metrics.diebold_mariano(same, "y", "q", "p", ("t",)).preferred == "model_b"
    assert metrics.diebold_mariano(same, "y", "q", "q", ("t",)).preferred is None
    assert metrics.t_two_sided(2.0, 10) == pytest.approx(0.073388, abs=1e-6)
    with pytest.raises(ValueError):
        metrics.diebold_mariano(same.limit(2), "y", "p", "q", ("t",))
    fit = models.create("gbt", trees=5, depth=3).fit(signal, ["f"], "y")
    assert models.evaluate(fit, signal, "y")["mae"] < models.evaluate(models.create("mean").fit(signal, ["f"], "y"), signal, "y")["mae"]
    with pytest.raises(RuntimeError):
        models.create("mean").predict(signal)


def test_metrics_by_value(spark):
    rng = np.random.default_rng(5)
    y, p, q = rng.normal(size=80) + 3, rng.normal(size=80) + 3, rng.normal(size=80) + 3.1
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(y, p, q))], "t int, y double, p double, q double").repartition(3)
    got = metrics.errors(df, "y", "p").first()
    assert got["mae"] == pytest.approx(np.abs(y - p).mean()) and got["rmse"] == pytest.approx(math.sqrt(((y - p) ** 2).mean()))
    assert got["mape"] == pytest.approx((np.abs(y - p) / (np.abs(y) + 1e-8)).mean())
    for loss, power in (("squared", 2), ("absolute", 1)):
        d = np.abs(y - p) ** power - np.abs(y - q) ** power
        for h in (1, 3, 5):
            c = d - d.mean()
            var = (c @ c / 80 + 2 * sum(np.mean(c[k:] * c[:-k]) for k in range(1, h))) / 80
            want = d.mean() / math.sqrt(var) * math.sqrt((80 + 1 - 2 * h + h * (h - 1) / 80) / 80)
            found = metrics.diebold_mariano(df, "y", "p", "q", ("t",), loss=loss, h=h)
            assert found.dm_statistic == pytest.approx(want) and 0 < found.p_value < 1
            assert found.preferred == ((None, "model_a", "model_b")[0 if found.p_value >= 0.05 else 1 if want < 0 else 2])


def test_guard_splits():
    assert guard_splits(500) == [(50, 150), (112, 212), (174, 274), (236, 336), (298, 398)]
    assert guard_splits(50) == [(30, 40)] and guard_splits(49) == [(30, 39), (31, 40)] and guard_splits(37) == [] == guard_splits(10)
    for n in range(20, 3000):
        first, val, last = max(30, n // 10), int(0.2 * n), n - int(0.2 * n) - int((1 - 0.6 - 0.2) * n)
        ends = [e for e, _ in guard_splits(n)]
        assert (ends == []) == (last < first) and {v - e for e, v in guard_splits(n)} <= {val}
        if ends:
            step = max(1, (last - first) // 4)
            assert ends == [first + k * step for k in range(len(ends))] and ends[-1] <= last and (len(ends) == 5 or ends[-1] + step > last)


def test_cuts(spark):
    ends = lambda pairs: sorted({x for p in pairs for x in p})
    lengths = spark.range(3000).withColumnRenamed("id", "n")
    cases = [(lambda n: expanding_splits(n), lambda n: expanding_cuts(n)), (lambda n: expanding_splits(n, 3, 10), lambda n: expanding_cuts(n, 3, 10))]
    cases += [((lambda n, f=f, t=t, v=v: guard_splits(n, f, t, v)), (lambda n, f=f, t=t, v=v: guard_cuts(n, f, t, v))) for f, t, v in ((5, 0.6, 0.2), (1, 0.6, 0.2), (3, 0.7, 0.15))]
    for splits, cuts in cases:
        for r in lengths.select("n", cuts(F.col("n")).alias("c")).collect():
            assert r.c == ends(splits(r.n)), r.n


def test_long_series_in_blocks(spark):
    """Without a coarse bucket and with one, over more rows than a block holds."""
    df = spark.range(9000).select(F.col("id").alias("t"), (F.col("id") % 3 == 0).alias("s"), F.sin(F.col("id") / 50).alias("f"), (F.sin(F.col("id") / 50) + F.cos(F.col("id") * 7)).alias("y"), F.cos(F.col("id") * 3).alias("p")).repartition(5)
    coarse = F.floor(F.col("t") / 100)
    for keys in ([], ["s"]):
        rows = lambda c: sorted(map(str, rolling_r2(df, "f", "y", keys, ["t"], 40, c).selectExpr(*keys, "round(r2, 6)").collect()))
        assert rows(None) == rows(coarse)
        score = lambda c: [(r.feature, *(r[k] for k in keys), round(r.score, 9)) for r in ols_scores(df, ["f", "p"], "y", keys, ["t"], coarse=c).orderBy(*keys, "feature").collect()]
        assert score(None) == score(coarse) and len(score(None)) == 2 * 2 ** len(keys)
        guard = lambda c: OverfittingGuard(stability_factor=6.0).filter(df, ["f", "p"], "y", keys, ["t"], c)
        assert guard(None) == guard(coarse)
    dm = lambda c: metrics.diebold_mariano(df, "y", "f", "p", ("t",), h=4, coarse=c)
    assert dm(None).dm_statistic == pytest.approx(dm(coarse).dm_statistic, rel=1e-9)


def test_mutations():
    m = Mutator(C, ["x", "y"], seed=9)
    tree = parse("add(ts_mean_5(x), 0.5)")
    for _ in range(40):
        assert str(m.resize_window(tree)) in {f"add(ts_mean_{w}(x), 0.5)" for w in (10, 21, 63, 126, 252)}
        assert str(m.swap_variable(tree)) == "add(ts_mean_5(y), 0.5)"
        new = m.swap_operator(tree)
        assert new != tree and new.size() == tree.size() and new.variables() == {"x"}
    assert m.swap_variable(parse("abs(1.0)")) == parse("abs(1.0)") and m.resize_window(parse("abs(x)")) == parse("abs(x)")
    rng = random.Random(2)
    found = [leaf(rng, ["x"], 0.25) for _ in range(2000)]
    share = sum(isinstance(e, Const) for e in found) / 2000
    assert 0.2 < share < 0.3 and all(abs(e.value) <= 1 for e in found if isinstance(e, Const)) and isinstance(leaf(rng, []), Const)
    s = AnnealingSchedule(1.0, 10, seed=0)
    assert s.metropolis_accept(0.0, 0.5) and not s.metropolis_accept(0.0, 0.0) and s.metropolis_accept(1e-9, 0.0)


def test_datasets(spark, tmp_path):
    loader = DatasetLoader(spark, str(tmp_path))
    assert loader.available_datasets() == ["sp500", "uci_appliances", "jena_climate"]
    with pytest.raises(ValueError):
        loader.load("nope")
    sp = loader.generate_synthetic("sp500")
    assert sp.count() == 5034 and len(sp.columns) == 27
    row = sp.agg(F.min("ts"), F.max("ts"), F.count_if(F.dayofweek("ts").isin(1, 7)), F.countDistinct("ts"), F.count("realized_vol_21d")).first()
    assert str(row[1])[:10] == "2024-12-31" and row[2] == 0 and row[3] == 5034 and row[4] == 5034
    assert loader.generate_synthetic("uci_appliances", 0.05).count() == 986
    assert loader.generate_synthetic("jena_climate", 0.02).count() == 8411 - 36
    (tmp_path / "jena_climate").mkdir()
    lines = ["Date Time,T (degC)"] + [f"01.01.2009 {i // 6:02d}:{i % 6}0:00,{i}.5" for i in range(60)]
    (tmp_path / "jena_climate" / "jena_climate_2009_2016.csv").write_text("\n".join(lines))
    df = loader.load("jena_climate")
    assert df.count() == 24 and df.orderBy("ts").first()["temperature_6h"] == 36.5
    for name, text in (("sp500/sp500.csv", "date,return_0,realized_vol_21d\n2024-01-02,0.5,0.1\n2024-01-03,,0.2\n"), ("uci_appliances/energydata_complete.csv", "date,Appliances,T1\n2016-01-11 17:00:00,60,19.9\n")):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    assert [tuple(r)[1:] for r in loader.load("sp500").orderBy("ts").collect()] == [(0.5, 0.1), (None, 0.2)]
    features, target = loader.load_split("uci_appliances")
    assert features.columns == ["ts", "T1"] and target.columns == ["ts", "energy_wh"] and target.first()["energy_wh"] == 60.0
