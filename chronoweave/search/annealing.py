"""Annealed search over expressions; each generation is scored in batched jobs."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ArithmeticException
from pyspark.sql import DataFrame, SparkSession

from ..functions.catalogue import Catalogue
from ..plans.compiler import SeriesFrame
from ..plans.expression import Expr, Mutator, grow
from .scoring import DualScorer

#: What an expression itself can be at fault for.
FAULTS = (ValueError, KeyError, AnalysisException, ArithmeticException)

#: Scores of expressions, -inf for those that can't be scored.
Scorer = Callable[[Sequence[Expr]], list[float]]


@dataclass
class AnnealingSchedule:
    tau_0: float = 1.0
    total_iterations: int = 200
    seed: int | None = None

    def __post_init__(self) -> None:
        if self.tau_0 <= 0 or self.total_iterations <= 0:
            raise ValueError("tau_0 and total_iterations must be positive")
        self.rng = random.Random(self.seed)

    def temperature(self, t: int) -> float:
        return max(1e-12, self.tau_0 * (1 - t / self.total_iterations))

    def metropolis_accept(self, delta: float, temperature: float) -> bool:
        """Always when better; never for a change that is no number; at temperature 0 only
        when better."""
        if math.isnan(delta) or delta <= 0 and temperature <= 0:
            return False
        return delta > 0 or self.rng.random() < math.exp(delta / temperature)


@dataclass
class SearchResult:
    pool: list[tuple[Expr, float]]
    history: list[tuple[int, float, float, int, float]] = field(default_factory=list)

    def pool_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(str(e), s) for e, s in self.pool], "expr string, score double")

    def history_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "iter int, best double, mean double, pool int, tau double")


class FeatureSearch:
    """pool: size; elites: changed each iteration; diversity: share of the pool's worst
    that is replaced by new expressions."""

    def __init__(self, catalogue: Catalogue, variables: Sequence[str], *, pool: int = 500, elites: int = 50, iterations: int = 200, tau_0: float = 1.0, diversity: float = 0.1, max_depth: int = 4, seed: int = 0):
        self.catalogue, self.names = catalogue, list(variables)
        self.pool, self.elites, self.iterations, self.diversity, self.max_depth = pool, elites, iterations, diversity, max_depth
        self.rng = random.Random(seed)
        self.schedule = AnnealingSchedule(tau_0, iterations, seed + 1)
        self.mutator = Mutator(catalogue, self.names, max_depth, seed + 2)

    def _new(self, n: int) -> list[Expr]:
        return [grow(self.catalogue, self.names, self.max_depth, rng=self.rng) for _ in range(n)]

    def search(self, scorer: Scorer, top_k: int = 50) -> SearchResult:
        known: dict[Expr, float] = {}

        def scored(trees: list[Expr]) -> list[tuple[Expr, float]]:
            new = [t for t in dict.fromkeys(trees) if t not in known]
            if new:
                known.update(zip(new, scorer(new)))
            return [(t, known[t]) for t in trees]

        best = lambda p: sorted(p, key=lambda x: -x[1])
        pool = scored(self._new(self.pool))
        history = []
        for t in range(self.iterations):
            tau = self.schedule.temperature(t)
            pool = best(pool)
            elites, rest = pool[: self.elites], pool[self.elites :]
            n_new = max(1, int(self.diversity * self.pool))
            # One batch: the changed elites and the fresh expressions of this generation.
            changed = [self.mutator.mutate(e) for e, _ in elites]
            fresh = self._new(n_new + max(0, self.pool - len(pool)))
            both = scored(changed + fresh)
            for i, new in enumerate(both[: len(elites)]):
                if self.schedule.metropolis_accept(new[1] - elites[i][1], tau):
                    elites[i] = new
            pool = best(elites + rest)
            pool = pool[: self.pool - len(fresh)] + both[len(elites) :]
            scores = [s for _, s in pool if math.isfinite(s)]
            history.append((t, max(scores, default=-math.inf), sum(scores) / len(scores) if scores else -math.inf, len(pool), tau))
        return SearchResult(best(pool)[:top_k], history)


def ols_scorer(frame: SeriesFrame, target: str, batch: int = 25, scorer: DualScorer | None = None) -> Scorer:
    """Scores by OLS, `batch` expressions to a job. A batch that an expression makes fail
    (it can't be analysed, or its arithmetic raises) is scored one by one, so that the
    failure stays its own. Lost executors and the like are not caught."""
    dual = scorer or DualScorer()

    def some(trees: Sequence[Expr]) -> list[float]:
        names = [f"_f{i}" for i in range(len(trees))]
        rows = frame.with_features(dict(zip(names, trees)))
        found = dual.ols(rows, names, target, frame.keys, frame.order)
        return [found[n] for n in names]

    def run(trees: Sequence[Expr]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(trees), batch):
            part = trees[i : i + batch]
            try:
                out += some(part)
            except FAULTS:
                for t in part:
                    try:
                        out += some([t])
                    except FAULTS:
                        out.append(-math.inf)
        return out

    return run
