"""From series to a short list of features: search, filters, and a test on rows kept back."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalogue import Catalogue
from ..functions.metrics import DieboldMariano, diebold_mariano, errors
from ..plans.compiler import CATALOGUE, SeriesFrame
from ..plans.expression import Expr
from ..plans.places import placed
from .annealing import FeatureSearch, SearchResult, ols_scorer
from .guards import OverfittingGuard
from .models import create
from .scoring import DualScorer


@dataclass(frozen=True)
class Settings:
    """The defaults of the method."""

    max_depth: int = 4
    pool: int = 500
    elites: int = 50
    iterations: int = 200
    tau_0: float = 1.0
    diversity: float = 0.1
    candidates: int = 50  # that the search hands to the filters
    features: int = 30  # that stay at most
    alpha: float = 0.6
    top: int = 100  # that the network scores
    vif_threshold: float = 5.0
    stability_factor: float = 2.0
    window: int = 252
    folds: int = 5
    train_share: float = 0.6
    val_share: float = 0.2

    # Beyond the method:
    network: bool = True  # rank candidates by the blend of both scores, not by OLS alone
    look_ahead: bool = True  # allow operators that see a series' later rows

    @classmethod
    def of(cls, values: Mapping[str, object]) -> Settings:
        known = {f.name: type(f.default) for f in fields(cls)}
        for name, value in values.items():
            if name not in known:
                raise ValueError(f"no setting {name!r}")
            if type(value) is not known[name] and not (known[name] is float and type(value) is int):
                raise ValueError(f"{name} is of type {known[name].__name__}")
        return cls(**{n: known[n](v) for n, v in values.items()})

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a JSON object in a file of the driver's."""
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))


@dataclass
class Found:
    features: dict[str, Expr]
    scores: dict[str, float]
    removed: dict[Expr, str]  # the filter that each of the other candidates fell at
    search: SearchResult

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(feature, expr, score), which ``write.json`` keeps and ``parse`` reads."""
        return spark.createDataFrame([(n, str(e), self.scores[n]) for n, e in self.features.items()], "feature string, expr string, score double")


class Discovery:
    """Each series' last rows, the share that is neither for training nor validation, are
    kept back: ``find`` never reads them, ``compare`` measures errors on them alone.
    ``coarse`` is that of ``placed()``."""

    def __init__(self, settings: Settings | None = None, seed: int = 0):
        self.settings, self.seed = settings or Settings(), seed
        ops = CATALOGUE.operators if self.settings.look_ahead else [o for o in CATALOGUE.operators if not o.uses_future]
        self.catalogue = Catalogue(operators=ops)

    def _marked(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], coarse: Column | None) -> DataFrame:
        seen = F.floor(F.col("_cw_total") * (self.settings.train_share + self.settings.val_share))
        return placed(df, keys, order, coarse).withColumn("_cw_seen", F.col("_cw_place") < seen).drop("_cw_place", "_cw_total")

    def find(self, df: DataFrame, variables: Sequence[str], target: str, keys: Sequence[str] = (), order: Sequence[str] = (), coarse: Column | None = None) -> Found:
        s = self.settings
        past = self._marked(df, keys, order, coarse).filter("_cw_seen").drop("_cw_seen")
        frame = SeriesFrame(past, tuple(keys), tuple(order))
        search = FeatureSearch(self.catalogue, variables, pool=s.pool, elites=s.elites, iterations=s.iterations, tau_0=s.tau_0, diversity=s.diversity, max_depth=s.max_depth, seed=self.seed)
        dual = DualScorer(s.alpha, s.top)
        result = search.search(ols_scorer(frame, target, scorer=dual), s.candidates)
        best = {e: score for e, score in dict(result.pool).items() if score > float("-inf")}
        trees = {f"f{i}": e for i, e in enumerate(best)}
        if not trees:
            return Found({}, {}, {}, result)
        rows = frame.with_features(trees)
        scores = {n: best[e] for n, e in trees.items()}
        if s.network:
            scores = dict(dual.score_batch(rows, list(trees), target, keys, order))
        ranked = sorted(scores, key=scores.get, reverse=True)
        guard = OverfittingGuard(s.vif_threshold, s.stability_factor, s.window, s.folds, train_share=s.train_share, val_share=s.val_share)
        keep = guard.filter(rows, ranked, target, keys, order, coarse)[: s.features]
        return Found({n: trees[n] for n in keep}, {n: scores[n] for n in keep}, {trees[n]: why for n, why in guard.removed.items()}, result)

    def compare(self, df: DataFrame, features: Mapping[str, Expr | str], variables: Sequence[str], target: str, keys: Sequence[str] = (), order: Sequence[str] = (), coarse: Column | None = None, model: str = "gbt", h: int = 1, **params) -> tuple[DataFrame, DieboldMariano]:
        """Errors (columns, mae, rmse, mape) on the rows kept back, of a model on the
        variables alone ("raw") and of one that has the features too ("features"), and the
        test between them, in which the first is model_a."""
        marked = SeriesFrame(self._marked(df, keys, order, coarse), tuple(keys), tuple(order)).with_features(features).dropna(subset=[target])
        out, sets = marked.filter("not _cw_seen"), {"raw": list(variables), "features": [*variables, *features]}
        for name, columns in sets.items():
            fit = create(model, **params).fit(marked.filter("_cw_seen"), columns, target)
            out = fit.predict(out).withColumnRenamed("prediction", f"_cw_{name}")
        table = None
        for name in sets:
            row = errors(out, target, f"_cw_{name}").select(F.lit(name).alias("columns"), "mae", "rmse", "mape")
            table = row if table is None else table.union(row)
        return table, diebold_mariano(out, target, "_cw_raw", "_cw_features", (*order, *keys), h=h, coarse=coarse)
