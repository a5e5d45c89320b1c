"""Surrogate scores of features against a target, on expanding windows.

All candidates are scored in one aggregate: rows fall into the segments between fold
bounds, each segment keeps its centred moments, and the moments of a training window
are those of its segments merged. What comes back per series is a few rows of moments.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.places import placed


@dataclass(frozen=True)
class Moments:
    n: int = 0
    mf: float = 0.0
    my: float = 0.0
    ff: float = 0.0  # centred sums
    fy: float = 0.0
    yy: float = 0.0

    def __add__(self, o: Moments) -> Moments:
        n = self.n + o.n
        if not self.n or not o.n:
            return o if not self.n else self
        df, dy, k = o.mf - self.mf, o.my - self.my, self.n * o.n / n
        return Moments(n, self.mf + df * o.n / n, self.my + dy * o.n / n, self.ff + o.ff + df * df * k, self.fy + o.fy + df * dy * k, self.yy + o.yy + dy * dy * k)

    def line(self, minimum_norm: bool) -> tuple[float, float]:
        """Slope and intercept. A constant f gives the solution of least norm, or the
        mean of y."""
        if self.ff > 1e-12 * max(1.0, self.n * self.mf * self.mf):
            slope = self.fy / self.ff
            return slope, self.my - slope * self.mf
        scale = self.my / (self.mf * self.mf + 1) if minimum_norm else 0.0
        return (scale * self.mf, scale) if minimum_norm else (0.0, self.my)

    def residual(self, slope: float, intercept: float) -> float:
        """Sum of squares of y less a line, over these rows."""
        off = self.my - slope * self.mf - intercept
        return max(0.0, self.yy - 2 * slope * self.fy + slope * slope * self.ff + self.n * off * off)


def expanding_splits(n: int, windows: int = 5, min_train: int = 63) -> list[tuple[int, int]]:
    """(end of training, end of test) of each fold; a test begins where training ends.
    Rows beyond the last equal step are never tested."""
    usable = n - min_train
    if usable < windows:
        return [(min_train, n)] if n > min_train else []
    step = max(1, usable // (windows + 1))
    return [(min_train + w * step, min(min_train + (w + 1) * step, n)) for w in range(1, windows + 1)]


def guard_splits(n: int, folds: int = 5, train_share: float = 0.6, val_share: float = 0.2) -> list[tuple[int, int]]:
    """(end of training, end of validation) of folds whose training grows by equal whole
    steps; the share that is left is held back. Empty where no training fits."""
    first, val = max(30, int(n * 0.1)), max(1, int(n * val_share))
    held = max(1, int(n * (1.0 - train_share - val_share)))
    room = n - held - val - first
    step = max(1, room // max(1, folds - 1))
    return [(first + k, first + k + val) for k in range(0, min(room, step * (folds - 1)) + 1, step)]


def _floor(c: Column) -> Column:
    return F.floor(c).cast("long")


def expanding_cuts(n: Column, windows: int = 5, min_train: int = 63) -> Column:
    """All ends in expanding_splits(n), ascending, for a column of lengths."""
    n, usable = n.cast("long"), n.cast("long") - min_train
    step = F.greatest(F.lit(1), _floor(usable / (windows + 1)))
    ends = F.array_distinct(F.array(*(F.least(min_train + w * step, n) for w in range(1, windows + 2))))
    return F.when(usable >= windows, ends).when(usable > 0, F.array(F.lit(min_train).cast("long"), n)).otherwise(F.array().cast("array<long>"))


def guard_cuts(n: Column, folds: int = 5, train_share: float = 0.6, val_share: float = 0.2) -> Column:
    """All ends in guard_splits(n), ascending, for a column of lengths."""
    n = n.cast("long")
    first = F.greatest(F.lit(30), _floor(n * 0.1))
    val = F.greatest(F.lit(1), _floor(n * val_share))
    held = F.greatest(F.lit(1), _floor(n * (1.0 - train_share - val_share)))
    room = n - held - val - first
    step = F.greatest(F.lit(1), _floor(room / max(1, folds - 1)))
    starts = F.filter(F.array(*(first + k * step for k in range(max(1, folds)))), lambda c: c <= first + room)
    return F.sort_array(F.array_distinct(F.concat(starts, F.transform(starts, lambda c: c + val))))


def fold_scores(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], order: Sequence[str], splits, cuts, finish, name: str = "score", coarse: Column | None = None) -> DataFrame:
    """(keys, feature, score) where finish(train, test) gives a fold's part and the
    parts are averaged; NULL without folds. ``splits`` gives the folds of a length, ``cuts``
    their ends as a column. They are at most twice the folds, so each series sends a bounded
    number of rows. With ``coarse`` (see ``placed()``) no task holds a whole series."""
    bucket = [] if coarse is None else [coarse.alias("_cw_coarse")]
    rows = df.select(*keys, *order, F.col(target).cast("double").alias("_cw_y"), *(F.col(f).cast("double") for f in features), *bucket)
    rows = placed(rows, keys, order, F.col("_cw_coarse") if bucket else None).withColumnRenamed("_cw_total", "_cw_n")
    rows = rows.withColumn("_cw_cuts", cuts(F.col("_cw_n")))
    seg = F.size(F.filter("_cw_cuts", lambda c: c <= F.col("_cw_place")))
    aggs = [F.count("_cw_y").alias("n"), F.avg("_cw_y").alias("my"), F.var_pop("_cw_y").alias("vy")]
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"m{i}"), F.var_pop(f).alias(f"v{i}"), F.covar_pop(f, "_cw_y").alias(f"c{i}")]
    moments = rows.filter(F.size("_cw_cuts") > 0).groupBy(*keys, "_cw_n", seg.alias("seg")).agg(*aggs)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_cw_n"].iloc[0])
        at = sorted({x for pair in splits(n) for x in pair})
        out = []
        for i, f in enumerate(features):
            by = {int(r.seg): Moments(int(r.n), r[f"m{i}"], r.my, r.n * r[f"v{i}"], r.n * r[f"c{i}"], r.n * r.vy) for _, r in pdf.iterrows()}
            parts = []
            for end, stop in splits(n):
                train = sum((by.get(s, Moments()) for s in range(at.index(end) + 1)), Moments())
                test = sum((by.get(s, Moments()) for s in range(at.index(end) + 1, at.index(stop) + 1)), Moments())
                if (part := finish(train, test)) is not None:
                    parts.append(part)
            out.append([*(pdf[k].iloc[0] for k in keys), f, float(np.mean(parts)) if parts else None])
        return pd.DataFrame(out, columns=[*keys, "feature", name])

    types = {x.name: x.dataType.simpleString() for x in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "feature string", f"{name} double"])
    return moments.groupBy(*(keys or [F.lit("")])).applyInPandas(score, schema)


def ols_part(penalty: float = 0.01):
    """Test R squared less a penalty times the BIC a row."""

    def finish(train: Moments, test: Moments) -> float | None:
        if not test.n:
            return None
        ss = test.residual(*train.line(minimum_norm=True))
        r2 = 1 - ss / test.yy if test.yy > 0 else 0.0
        bic = test.n * math.log(ss / test.n) + 2 * math.log(test.n) if ss > 0 else 0.0
        return r2 - penalty * bic / test.n

    return finish


def validation_r2(train: Moments, test: Moments) -> float | None:
    if test.n < 2:
        return None
    ss = test.residual(*train.line(minimum_norm=False))
    return 1 - ss / test.yy if test.yy > 0 else float(ss == 0)


def ols_scores(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), order: Sequence[str] = (), windows: int = 5, min_train: int = 63, penalty: float = 0.01, coarse: Column | None = None) -> DataFrame:
    splits, cuts = (lambda n: expanding_splits(n, windows, min_train)), (lambda n: expanding_cuts(n, windows, min_train))
    return fold_scores(df, features, target, keys, order, splits, cuts, ols_part(penalty), coarse=coarse)


class Mlp:
    """A small regression network: standardised inputs, rectifiers, Adam. Seeded."""

    def __init__(self, hidden: tuple[int, ...] = (64, 32), rate: float = 1e-3, epochs: int = 50, batch: int = 200, l2: float = 1e-4, tol: float = 1e-4, patience: int = 10, seed: int = 0):
        self.hidden, self.rate, self.epochs, self.batch, self.l2, self.tol, self.patience, self.seed = hidden, rate, epochs, batch, l2, tol, patience, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Mlp:
        rng = np.random.default_rng(self.seed)
        self.mean, self.sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        x, sizes = (x - self.mean) / self.sd, [x.shape[1], *self.hidden, 1]
        self.w = [rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        params = self.w + self.b
        m, v, t, best, stale = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, math.inf, 0
        for _ in range(self.epochs):
            loss, perm = 0.0, rng.permutation(len(x))
            for i in range(0, len(x), self.batch):
                at = perm[i : i + self.batch]
                acts = self._forward(x[at])
                err = acts[-1][:, 0] - y[at]
                loss += float(err @ err) / 2
                g, gw, gb = err[:, None] / len(at), [], []
                for k in range(len(self.w) - 1, -1, -1):
                    gw.insert(0, acts[k].T @ g + self.l2 * self.w[k] / len(at))
                    gb.insert(0, g.sum(0))
                    g = (g @ self.w[k].T) * (acts[k] > 0) if k else g
                t += 1
                for j, (p, grad) in enumerate(zip(params, gw + gb)):
                    m[j] += 0.1 * (grad - m[j])
                    v[j] += 0.001 * (grad * grad - v[j])
                    p -= self.rate * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[j] / (np.sqrt(v[j]) + 1e-8)
            loss /= len(x)
            stale = stale + 1 if loss > best - self.tol else 0
            best = min(best, loss)
            if stale >= self.patience:
                break
        return self

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if k < len(self.w) - 1 else z)
        return acts

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.sd)[-1][:, 0]


def mlp_scores(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), order: Sequence[str] = (), windows: int = 5, min_train: int = 63, seed: int = 0) -> DataFrame:
    """(keys, feature, score): mean test R squared of a network per fold. A series and
    one feature of it are held by one task; meant for the few best candidates."""
    long = df.select(*keys, *order, F.col(target).cast("double").alias("_cw_y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_cw_f")) for f in features))).alias("_cw_s")).select(*keys, *order, "_cw_y", "_cw_s.feature", "_cw_s._cw_f")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        x, y, parts = pdf[["_cw_f"]].to_numpy(), pdf["_cw_y"].to_numpy(), []
        for end, stop in expanding_splits(len(y), windows, min_train):
            p = Mlp(seed=seed).fit(x[:end], y[:end]).predict(x[end:stop])
            v = y[end:stop].var()
            part = 1.0 if v == 0 else 1 - float(np.mean((p - y[end:stop]) ** 2)) / v
            if math.isfinite(part):
                parts.append(part)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), pdf["feature"].iloc[0], float(np.mean(parts)) if parts else None]], columns=[*keys, "feature", "score"])

    types = {c.name: c.dataType.simpleString() for c in df.schema.fields}
    return long.groupBy(*keys, "feature").applyInPandas(score, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "feature string", "score double"]))


class DualScorer:
    """OLS for all candidates, the network for the best of them, and a blend."""

    def __init__(self, alpha: float = 0.6, top: int = 100, batch: int = 32):
        self.alpha, self.top, self.batch = alpha, top, batch

    def score(self, df: DataFrame, feature: str, target: str, keys: Sequence[str], order: Sequence[str]) -> float:
        return self.ols(df, [feature], target, keys, order)[feature]

    def ols(self, df, features, target, keys, order) -> dict[str, float]:
        """Mean over series; -inf where no fold exists."""
        rows = ols_scores(df, features, target, keys, order).groupBy("feature").agg(F.avg("score").alias("s")).collect()
        found = {r["feature"]: r["s"] for r in rows}
        return {f: s if (s := found.get(f)) is not None and math.isfinite(s) else -math.inf for f in features}

    def score_batch(self, df, features, target, keys, order) -> list[tuple[str, float]]:
        ols: dict[str, float] = {}
        for i in range(0, len(features), self.batch):  # plans of bounded width
            ols |= self.ols(df, features[i : i + self.batch], target, keys, order)
        best = sorted((f for f in features if math.isfinite(ols[f])), key=ols.get, reverse=True)[: self.top]
        if not best:
            return []
        rows = mlp_scores(df, best, target, keys, order).groupBy("feature").agg(F.avg("score").alias("s")).collect()
        net = {r["feature"]: r["s"] if r["s"] is not None and math.isfinite(r["s"]) else 0.0 for r in rows}
        return sorted(((f, self.alpha * ols[f] + (1 - self.alpha) * net.get(f, 0.0)) for f in best), key=lambda x: -x[1])
