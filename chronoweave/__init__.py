"""Time-series features, their search and their evaluation on Spark DataFrames.

The names below are the public interface; each is loaded when it is first used, so that
workers don't load what they don't need. The corpus operators in ``llm`` are a part of
their own, which nothing here imports.
"""

from importlib import import_module

_NAMES = {
    "functions.catalogue": "Catalogue Family Operator",
    "functions.metrics": "diebold_mariano errors mae mape rmse",
    "plans.compiler": "SeriesFrame evaluate register_operator",
    "plans.expression": "Call Const Expr Mutator Var grow grow_full parse",
    "plans.lookback": "lookback with_features_by_bucket with_features_in_blocks",
    "search.annealing": "AnnealingSchedule FeatureSearch SearchResult ols_scorer",
    "search.discovery": "Discovery Found Settings",
    "search.guards": "OverfittingGuard inflation_factors rolling_r2",
    "search.models": "MODELS create",
    "search.scoring": "DualScorer mlp_scores ols_scores",
    "sources.datasets": "DatasetLoader",
    "streaming.rolling": "RollingStream",
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names.split()}

__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
