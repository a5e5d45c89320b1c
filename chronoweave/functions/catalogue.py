"""The operator catalogue: 108 base operators, 373 with their windows."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

#: Window lengths of rolling operators, in rows.
WINDOWS = (5, 10, 21, 63, 126, 252)


class Family(str, Enum):
    ARITHMETIC = "arithmetic"
    STATISTICAL = "statistical"
    CROSS_SECTIONAL = "cross_sectional"
    ROLLING_WINDOW = "rolling_window"


@dataclass(frozen=True)
class Operator:
    name: str
    family: Family
    arity: int
    window: int | None = None
    base_name: str = ""
    uses_future: bool = False

    @property
    def has_window(self) -> bool:
        return self.window is not None


#: Operator names by family and arity.
_ARITHMETIC = {1: "log abs sign clip neg sqrt exp", 2: "add sub mul div power"}
_STATISTICAL = {
    1: "mean median quantile_25 quantile_75 quantile_10 quantile_90 std var mad iqr skew kurtosis zscore min_max_scale robust_scale sharpe sortino max_drawdown cumsum cumprod cummax cummin pct_change",
    2: "information_ratio corr cov beta residual",
}
_CROSS = {1: "rank percentile demean zscore_cs normalize winsorize rank_pct scale cs_max cs_min cs_mean cs_std cs_median cs_sum cs_count_positive"}
_ROLLING = {
    1: "ts_mean ts_std ts_rank ts_delta ts_decay_linear ts_min ts_max ts_sum ts_skew ts_kurt ts_zscore ts_ir ts_median ts_var ts_argmax ts_argmin ts_pct_change ts_return ts_log_return ts_cumsum ts_cumprod ts_cummax ts_cummin ts_ema ts_wma ts_momentum ts_rsi ts_maxdrawdown ts_volatility ts_autocorr ts_entropy ts_mad ts_iqr ts_count_positive ts_count_negative ts_quantile_25 ts_quantile_75 ts_range ts_cv ts_sharpe",
    2: "ts_corr ts_cov ts_regression ts_beta ts_residual ts_mutual_info ts_granger ts_cross_corr ts_relative_strength ts_tracking_error ts_information_ratio ts_cosine_sim ts_dtw",
}
#: Statistics that only look back; all others of their families see the whole series.
_CAUSAL = {"max_drawdown", "cumsum", "cumprod", "cummax", "cummin", "pct_change"}

#: Operators with the same formula as another; compiled once.
ALIASES = {
    "ts_volatility": "ts_std",
    "ts_return": "ts_delta",
    "ts_wma": "ts_decay_linear",
    "ts_cumsum": "ts_sum",
    "ts_cummax": "ts_max",
    "ts_cummin": "ts_min",
    "ts_sharpe": "ts_ir",
    "ts_cross_corr": "ts_corr",
    "ts_beta": "ts_regression",
    "rank_pct": "percentile",
    "scale": "normalize",
    "zscore_cs": "zscore",
    "cs_mean": "mean",
    "cs_std": "std",
    "cs_median": "median",
}


def _build() -> list[Operator]:
    out = []
    for family, names in ((Family.ARITHMETIC, _ARITHMETIC), (Family.STATISTICAL, _STATISTICAL), (Family.CROSS_SECTIONAL, _CROSS)):
        for arity, text in names.items():
            future = family is not Family.ARITHMETIC
            out += [Operator(n, family, arity, None, n, future and n not in _CAUSAL) for n in text.split()]
    for arity, text in _ROLLING.items():
        out += [Operator(f"{n}_{w}", Family.ROLLING_WINDOW, arity, w, n) for n in text.split() for w in WINDOWS]
    return out


class Catalogue:
    """Look-ups and sampling; one seeded generator serves every draw."""

    def __init__(self, seed: int | None = None, operators: Sequence[Operator] | None = None):
        self._ops = tuple(operators if operators is not None else _build())
        self._by_name = {o.name: o for o in self._ops}
        self.rng = random.Random(seed)

    @property
    def operators(self) -> tuple[Operator, ...]:
        return self._ops

    @property
    def families(self) -> list[Family]:
        return list(dict.fromkeys(o.family for o in self._ops))

    @property
    def num_operators(self) -> int:
        return len(self._ops)

    def get(self, name: str) -> Operator:
        try:
            return self._by_name[name]
        except KeyError:
            raise KeyError(f"no operator {name!r}") from None

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def select(self, *, family: Family | None = None, arity: int | None = None) -> list[Operator]:
        return [o for o in self._ops if family in (None, o.family) and arity in (None, o.arity)]

    def by_family(self, family: Family) -> list[Operator]:
        return self.select(family=family)

    def by_arity(self, arity: int) -> list[Operator]:
        return self.select(arity=arity)

    def by_base_name(self, base: str) -> list[Operator]:
        return [o for o in self._ops if o.base_name == base]

    def sample(self, *, family: Family | None = None, arity: int | None = None, rng: random.Random | None = None) -> Operator:
        return self.sample_n(1, family=family, arity=arity, rng=rng)[0]

    def sample_n(self, n: int, *, family: Family | None = None, arity: int | None = None, replace: bool = True, rng: random.Random | None = None) -> list[Operator]:
        pool, rng = self.select(family=family, arity=arity), rng or self.rng
        if not pool:
            raise ValueError("no operator fits the filter")
        return rng.choices(pool, k=n) if replace else rng.sample(pool, n)

    def summary(self) -> dict[str, int]:
        return dict(Counter(o.family.value for o in self._ops))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(o.name, o.family.value, o.arity, o.window, o.base_name, o.uses_future) for o in self._ops]
        return spark.createDataFrame(rows, "name string, family string, arity int, window int, base_name string, uses_future boolean")
