"""Operators over the last w rows. A row with fewer rows behind it gives 0."""

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .base import EPS, POS, Series, clamp, finite, full, let, of, ratio, zero


def _simple(aggregate):
    return lambda s, w, a: full(w, aggregate(a).over(s.last(w)))


def _values(x: Column, s: Series, w: int) -> Column:
    """The window's values in order, missing ones kept in their place."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))).over(s.last(w)), lambda e: e["v"])


def _total(xs: Column, f) -> Column:
    return F.aggregate(xs, zero(), lambda t, x: t + F.coalesce(f(x), zero()))


def ts_rank(s: Series, w: int, a: Column) -> Column:
    below = F.filter(F.collect_list(a).over(s.last(w)), lambda x: x <= a)
    return full(w, F.when(a.isNotNull(), F.size(below) / F.lit(float(w))))


def _back(s: Series, w: int, f) -> Column:
    """f of the value w rows back, 0 on the first w rows; a missing value there or here
    stays missing where the formula lets it."""
    return F.when(F.col(POS) > w, f(lambda a: F.lag(a, w).over(s.ordered))).otherwise(zero())


def ts_delta(s: Series, w: int, a: Column) -> Column:
    return _back(s, w, lambda lag: a - lag(a))


def ts_pct_change(s: Series, w: int, a: Column) -> Column:
    change = lambda a, x: F.when(F.abs(x) > EPS, ratio(a - x, F.abs(x) + EPS)).otherwise(zero())
    return _back(s, w, lambda lag: let(lag(a), lambda x: change(a, x)))


def ts_log_return(s: Series, w: int, a: Column) -> Column:
    return _back(s, w, lambda lag: let(lag(a), lambda x: F.when((a > EPS) & (x > EPS), F.ln(ratio(a, x))).otherwise(zero())))


def ts_momentum(s: Series, w: int, a: Column) -> Column:
    return _back(s, w, lambda lag: let(lag(a), lambda x: F.when(F.abs(x) + EPS > EPS, ratio(a, F.abs(x) + EPS)).otherwise(zero())))


def ts_decay_linear(s: Series, w: int, a: Column) -> Column:
    """Weights 1 to w, oldest first; a missing value adds nothing. In its block, row k of
    this half weighs w - j + k and row k of the half before k - j, j the row here."""
    k = ((F.col(POS) - 1) % w).cast("double")
    halves = s.halves(w, n=F.count(a), s0=F.sum(a), s1=F.sum(k * a))

    def value(t: Column, j: Column) -> Column:
        sum_ = lambda part, name: F.coalesce(part[name], zero())
        here = sum_(t, "s1") + (w - j) * sum_(t, "s0")
        before = sum_(t["before"], "s1") - j * sum_(t["before"], "s0")
        return F.when(t["n"] + F.coalesce(t["before"]["n"], F.lit(0)) > 0, (here + before) * (2.0 / (w * (w + 1))))

    return full(w, let(halves, lambda t: value(t, k)))


def _moment(k: int, less: float):
    """Standardised moment with EPS added to the deviation."""

    def compile_(s: Series, w: int, a: Column) -> Column:
        r = s.last(w)
        raw = F.skewness(a).over(r) if k == 3 else F.kurtosis(a).over(r) + 3
        value = lambda t: F.when(t["sd"] > EPS, t["raw"] * F.pow(ratio(t["sd"], t["sd"] + EPS), F.lit(float(k))) - less)
        return full(w, of(value, sd=F.stddev_pop(a).over(r), raw=raw))

    return compile_


def ts_zscore(s: Series, w: int, a: Column) -> Column:
    value = lambda t: F.when(t["sd"] > EPS, ratio(a - t["m"], t["sd"]))
    return full(w, of(value, sd=F.stddev_pop(a).over(s.last(w)), m=F.avg(a).over(s.last(w))))


def _information(x: Column, r: WindowSpec) -> Column:
    return of(lambda t: F.when(t["sd"] > EPS, ratio(t["m"], t["sd"])), sd=F.stddev_samp(x).over(r), m=F.avg(x).over(r))


def ts_ir(s: Series, w: int, a: Column) -> Column:
    return full(w, _information(a, s.last(w)))


def _argument(aggregate, sign: int):
    """Place in the window, 0 the oldest, of the first extreme value."""

    def compile_(s: Series, w: int, a: Column) -> Column:
        pos = F.col(POS).cast("long")
        best = aggregate(F.when(a.isNotNull(), F.struct(a, pos * sign))).over(s.last(w))
        return full(w, (best["col2"] * sign - (pos - w + 1)).cast("double"))

    return compile_


def ts_cumprod(s: Series, w: int, a: Column) -> Column:
    some = F.count(a).over(s.last(w)) > 0
    return full(w, F.when(some, F.product(clamp(a, 1e4)).over(s.last(w))))


def ts_rsi(s: Series, w: int, a: Column) -> Column:
    step = a - F.lag(a).over(s.ordered)
    total = lambda x: F.coalesce(F.sum(x).over(s.last(w)), zero())
    parts = {"gain": total(F.when(step > 0, step)), "loss": total(F.when(step < 0, -step))}
    return F.when(F.col(POS) > w, of(lambda t: ratio(100.0 * t["gain"], t["gain"] + t["loss"] + EPS), **parts)).otherwise(zero())


def _full_windows(x: Column, s: Series, w: int) -> Column:
    """The values of full windows, NULL before; what Arrow-batched functions take."""
    return F.when(F.col(POS) >= w, _values(x, s, w))


@lru_cache(maxsize=None)
def _drawdown_udf():
    @F.pandas_udf("double")
    def fall(windows: pd.Series) -> pd.Series:
        out, some = np.zeros(len(windows)), windows.notna().to_numpy()
        if some.any():
            x = np.stack(windows[some].to_numpy()).astype(float)
            low = np.maximum.accumulate(x, axis=1) - x  # missing from the first missing value on
            out[some] = np.where(np.isnan(low), 0.0, low).max(axis=1)
        return pd.Series(out)

    return fall


def ts_maxdrawdown(s: Series, w: int, a: Column) -> Column:
    """Largest fall below the running maximum; counting stops at a missing value. A fold
    over every window, so it runs on whole batches of windows in NumPy."""
    return full(w, _drawdown_udf()(_full_windows(a, s, w)))


def ts_autocorr(s: Series, w: int, a: Column) -> Column:
    """Mean of neighbouring centred products over the population variance."""
    r = s.last(w)

    def value(t: Column) -> Column:
        products = F.zip_with(F.slice(t["xs"], 1, w - 1), F.slice(t["xs"], 2, w - 1), lambda x, y: (x - t["m"]) * (y - t["m"]))
        mean = let(F.filter(products, lambda p: p.isNotNull()), lambda ps: ratio(_total(ps, lambda p: p), F.size(ps).cast("double")))
        return F.when(F.sqrt(t["v"]) >= EPS, ratio(mean, t["v"]))

    return full(w, of(value, m=F.avg(a).over(r), v=F.var_pop(a).over(r), xs=_values(a, s, w)))


def ts_entropy(s: Series, w: int, a: Column) -> Column:
    x = F.abs(a) + EPS
    value = lambda t: -_total(t["xs"], lambda x: ratio(x, t["sum"]) * F.ln(ratio(x, t["sum"]) + EPS))
    return full(w, of(value, xs=F.collect_list(x).over(s.last(w)), sum=F.sum(x).over(s.last(w))))


def ts_mad(s: Series, w: int, a: Column) -> Column:
    r = s.last(w)
    m, n = F.avg(a).over(r), F.count(a).over(r)
    return full(w, ratio(_total(F.collect_list(a).over(r), lambda x: F.abs(x - m)), n.cast("double")))


def _quantiles(f):
    """All quantiles of a window from one sorted array."""

    def at(x: Column, q: float) -> Column:
        place = (F.size(x) - 1) * F.lit(q)
        low, high = F.get(x, F.floor(place).cast("int")), F.get(x, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return lambda s, w, a: full(w, let(F.sort_array(F.collect_list(a).over(s.last(w))), lambda x: f(lambda q: at(x, q))))


def ts_range(s: Series, w: int, a: Column) -> Column:
    return full(w, F.max(a).over(s.last(w)) - F.min(a).over(s.last(w)))


def _count(test):
    return lambda s, w, a: full(w, F.count_if(test(a)).over(s.last(w)).cast("double"))


def ts_cv(s: Series, w: int, a: Column) -> Column:
    r = s.last(w)
    return full(w, ratio(F.stddev_samp(a).over(r), F.abs(F.avg(a).over(r)) + EPS))


def _both(w: int, r: WindowSpec, a: Column, b: Column, x: Column) -> Column:
    """0 also where either column is missing all through the window."""
    return full(w, F.when((F.count(a).over(r) > 0) & (F.count(b).over(r) > 0), x))


def _pair(s: Series, w: int, a: Column, b: Column, f) -> Column:
    """f of the window's moments: means, variances of each column's own values, and the
    covariance of statistical.pair_cov; NULL where a column is missing all through."""
    both = a.isNotNull() & b.isNotNull()
    own = {f"{k}{name}": g(x) for name, x in (("a", a), ("b", b)) for k, g in (("n", F.count), ("m", F.avg), ("v", F.var_pop))}
    shared = {f"m{name}": F.avg(F.when(both, x)) for name, x in (("x", a), ("y", b))}
    halves = s.halves(w, n=F.count_if(both), c=F.covar_pop(a, b), **own, **shared)

    def joined(t: Column) -> Column:
        q = t["before"]
        get = lambda part, name: F.coalesce(part[name].cast("double"), zero())

        def moments(n: str, first: str, second: str, spread: str) -> tuple[Column, Column, Column]:
            """Mean of `first`, and variance or covariance, of both halves together."""
            n1, n2 = get(t, n), get(q, n)
            step = ratio(n2, n1 + n2)
            d1, d2 = get(q, first) - get(t, first), get(q, second) - get(t, second)
            return n1 + n2, F.when(n1 > 0, get(t, first) + d1 * step).otherwise(get(q, first)), ratio(n1 * get(t, spread) + n2 * get(q, spread), n1 + n2) + F.when((n1 > 0) & (n2 > 0), d1 * d2 * step * (1 - step)).otherwise(zero())

        (na, ma, va), (nb, mb, vb) = (moments(f"n{x}", f"m{x}", f"m{x}", f"v{x}") for x in "ab")
        (n, mx, c), (_, my, _) = moments("n", "mx", "my", "c"), moments("n", "my", "mx", "c")
        cov = F.when(n > 0, c + (mx - ma) * (my - mb))
        return F.when((na > 0) & (nb > 0), F.struct(ma.alias("ma"), va.alias("va"), mb.alias("mb"), vb.alias("vb"), cov.alias("cov")))

    return let(let(halves, joined), f)


def _slope(t: Column) -> Column:
    return F.when(t["vb"] >= EPS, ratio(t["cov"], t["vb"]))


def ts_corr(s: Series, w: int, a: Column, b: Column) -> Column:
    sa, sb = (lambda t: F.sqrt(t["va"])), (lambda t: F.sqrt(t["vb"]))
    return full(w, _pair(s, w, a, b, lambda t: F.when((sa(t) >= EPS) & (sb(t) >= EPS), ratio(t["cov"], sa(t) * sb(t)))))


def ts_cov(s: Series, w: int, a: Column, b: Column) -> Column:
    return full(w, _pair(s, w, a, b, lambda t: t["cov"]))


def ts_regression(s: Series, w: int, a: Column, b: Column) -> Column:
    return full(w, _pair(s, w, a, b, _slope))


def ts_residual(s: Series, w: int, a: Column, b: Column) -> Column:
    """Of the window's regression of a on b, at the last row; not guarded, so a missing
    value here stays missing."""
    rest = lambda t: F.when(t["vb"] < EPS, a).otherwise(a - (t["ma"] - _slope(t) * t["mb"] + _slope(t) * b))
    return F.when(F.col(POS) >= w, _pair(s, w, a, b, rest)).otherwise(zero())


@lru_cache(maxsize=None)
def _information_udf(bins: int):
    def cells(x: np.ndarray) -> np.ndarray:
        """Bin of each value: how many inner edges it has reached."""
        low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
        low, high = np.where(low == high, low - 0.5, low), np.where(low == high, high + 0.5, high)
        return sum((x >= low + i * ((high - low) / bins)).astype(np.int64) for i in range(1, bins))

    @F.pandas_udf("double")
    def information(left: pd.Series, right: pd.Series) -> pd.Series:
        out, some = np.zeros(len(left)), (left.notna() & right.notna()).to_numpy()
        if some.any():
            a, b = (np.stack(x[some].to_numpy()).astype(float) for x in (left, right))
            good = ~(np.isnan(a) | np.isnan(b)).any(axis=1)
            a, b, n = a[good], b[good], a.shape[1]
            at = cells(a) * bins + cells(b) + np.arange(len(a))[:, None] * bins * bins
            p = np.bincount(at.ravel(), minlength=len(a) * bins * bins).reshape(-1, bins, bins) / n
            apart = p.sum(axis=2, keepdims=True) * p.sum(axis=1, keepdims=True)
            terms = p * np.log(np.where(p > EPS, p, 1.0) / np.where(p > EPS, apart, 1.0))
            out[np.flatnonzero(some)[good]] = terms.sum(axis=(1, 2))
        return pd.Series(out)

    return information


def ts_mutual_info(s: Series, w: int, a: Column, b: Column, bins: int = 5) -> Column:
    """In nats, over equal-width bins of the window's own range; 0 where a value is
    missing. A constant column fills one bin. Batches of windows in NumPy, like
    ts_maxdrawdown."""
    return full(w, _information_udf(bins)(_full_windows(a, s, w), _full_windows(b, s, w)))


def ts_granger(s: Series, w: int, a: Column, b: Column) -> Column:
    """Correlation of a with b one row earlier, over the window's w - 1 such pairs; 0 if
    one is missing."""
    r, before = s.last(w - 1), F.lag(b).over(s.ordered)
    # Not F.corr, which raises in ANSI mode where a column is constant.
    spread = F.stddev_pop(a).over(r) * F.stddev_pop(before).over(r)
    return full(w, F.when(F.count(a + before).over(r) == w - 1, ratio(F.covar_pop(a, before).over(r), spread)))


def ts_relative_strength(s: Series, w: int, a: Column, b: Column) -> Column:
    r = s.last(w)
    value = lambda t: F.when(F.abs(t["mb"]) > EPS, ratio(t["ma"], t["mb"] + EPS))
    return _both(w, r, a, b, of(value, ma=F.avg(a).over(r), mb=F.avg(b).over(r)))


def ts_tracking_error(s: Series, w: int, a: Column, b: Column) -> Column:
    return full(w, F.stddev_samp(a - b).over(s.last(w)))


def ts_information_ratio(s: Series, w: int, a: Column, b: Column) -> Column:
    return full(w, _information(a - b, s.last(w)))


def ts_cosine_sim(s: Series, w: int, a: Column, b: Column) -> Column:
    r = s.last(w)
    value = lambda t: F.when((t["na"] >= EPS) & (t["nb"] >= EPS), ratio(t["ab"], t["na"] * t["nb"]))
    return full(w, of(value, ab=F.sum(a * b).over(r), na=F.sqrt(F.sum(a * a).over(r)), nb=F.sqrt(F.sum(b * b).over(r))))


def ts_dtw(s: Series, w: int, a: Column, b: Column) -> Column:
    """Mean absolute difference; no time warping is done."""
    return full(w, F.avg(F.abs(a - b)).over(s.last(w)))


COMPILE = {
    "ts_mean": _simple(F.avg),
    "ts_std": _simple(F.stddev_samp),
    "ts_var": _simple(F.var_samp),
    "ts_min": _simple(F.min),
    "ts_max": _simple(F.max),
    "ts_sum": _simple(F.sum),
    "ts_rank": ts_rank,
    "ts_delta": ts_delta,
    "ts_decay_linear": ts_decay_linear,
    "ts_skew": _moment(3, 0.0),
    "ts_kurt": _moment(4, 3.0),
    "ts_zscore": ts_zscore,
    "ts_ir": ts_ir,
    "ts_median": _quantiles(lambda q: q(0.5)),
    "ts_quantile_25": _quantiles(lambda q: q(0.25)),
    "ts_quantile_75": _quantiles(lambda q: q(0.75)),
    "ts_iqr": _quantiles(lambda q: q(0.75) - q(0.25)),
    "ts_argmax": _argument(F.max, -1),
    "ts_argmin": _argument(F.min, 1),
    "ts_pct_change": ts_pct_change,
    "ts_log_return": ts_log_return,
    "ts_cumprod": ts_cumprod,
    "ts_momentum": ts_momentum,
    "ts_rsi": ts_rsi,
    "ts_maxdrawdown": ts_maxdrawdown,
    "ts_autocorr": ts_autocorr,
    "ts_entropy": ts_entropy,
    "ts_mad": ts_mad,
    "ts_count_positive": _count(lambda a: a > 0),
    "ts_count_negative": _count(lambda a: a < 0),
    "ts_range": ts_range,
    "ts_cv": ts_cv,
    "ts_corr": ts_corr,
    "ts_cov": ts_cov,
    "ts_regression": ts_regression,
    "ts_residual": ts_residual,
    "ts_mutual_info": ts_mutual_info,
    "ts_granger": ts_granger,
    "ts_relative_strength": ts_relative_strength,
    "ts_tracking_error": ts_tracking_error,
    "ts_information_ratio": ts_information_ratio,
    "ts_cosine_sim": ts_cosine_sim,
    "ts_dtw": ts_dtw,
}
