"""Compile expressions to columns.

All expressions of a call are folded into one graph in which equal subtrees, and
operators of equal formulas, occur once. Its levels become one projection each, so that
a window over a window is a window over a column, and windows of a level share one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import ALIASES, Catalogue, Family, Operator
from ..operators import arithmetic, cross_sectional, recursive, rolling, statistical
from ..operators.base import POS, Series, sanitise
from .expression import Call, Const, Expr, Var, parse

COMPILE: dict[str, Callable[..., Column]] = {**arithmetic.COMPILE, **statistical.COMPILE, **cross_sectional.COMPILE, **rolling.COMPILE, **recursive.COMPILE}
CATALOGUE = Catalogue()


def register_operator(op: Operator, compile_fn: Callable[..., Column]) -> None:
    """Add an operator of one's own: compile_fn(series, [window,] *columns)."""
    global CATALOGUE
    if op.name in CATALOGUE or op.base_name in COMPILE and not op.has_window:
        raise ValueError(f"{op.name} exists")
    COMPILE[op.base_name] = compile_fn
    CATALOGUE = Catalogue(operators=(*CATALOGUE.operators, op))


def _same(e: Expr) -> Expr:
    """Aliases by the name of the operator that stands for them."""
    if not isinstance(e, Call):
        return e
    op = CATALOGUE.get(e.op)
    base = ALIASES.get(op.base_name, op.base_name)
    return Call(f"{base}_{op.window}" if op.has_window else base, tuple(map(_same, e.args)))


@dataclass(frozen=True)
class SeriesFrame:
    """A DataFrame of series: ``keys`` name the series, ``order`` its rows.

    ``order`` must be total within a series (end it with a unique column), else results
    depend on how rows happen to arrive. Without keys all rows are one series. Columns
    whose names start with ``_cw_`` are reserved.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def series(self) -> Series:
        return Series(self.keys or (F.lit(0),), self.order)

    def with_features(self, features: Mapping[str, Expr | str], *, missing: str = "error", root: bool = True) -> DataFrame:
        """The rows with one column per feature.

        missing: "error", or "zero" for variables that the frame lacks to be 0.
        root: apply the final clamp, after which no value is missing or infinite.
        """
        trees = {name: _same(parse(e, CATALOGUE) if isinstance(e, str) else e) for name, e in features.items()}
        have = set(self.df.columns)
        if clash := set(trees) & have:
            raise ValueError(f"the frame has columns {sorted(clash)}")
        names: dict[Expr, str] = {}
        levels: dict[int, list[Call]] = {}
        leaves: dict[str, Column] = {}
        for tree in trees.values():
            for node in tree.nodes():
                if node in names:
                    continue
                names[node] = f"_cw_{len(names)}"
                if isinstance(node, Call):
                    levels.setdefault(node.depth(), []).append(node)
                elif isinstance(node, Const):
                    leaves[names[node]] = F.lit(float(node.value))
                elif node.name in have:
                    x = F.col("`" + node.name.replace("`", "``") + "`").cast("double")
                    leaves[names[node]] = F.nanvl(x, F.lit(None).cast("double"))
                elif missing == "zero":
                    leaves[names[node]] = F.lit(0.0)
                else:
                    raise ValueError(f"no column {node.name!r}")
        s = self.series
        out = self.df.withColumns(leaves)
        if any(CATALOGUE.get(n.op).family is not Family.ARITHMETIC for level in levels.values() for n in level):
            out = out.withColumn(POS, F.row_number().over(s.ordered))
        for depth in sorted(levels):
            out = out.withColumns({names[n]: self._column(n, s, names) for n in levels[depth]})
        finish = sanitise if root else (lambda c: c)
        return out.select(*self.df.columns, *(finish(F.col(names[t])).alias(name) for name, t in trees.items()))

    @staticmethod
    def _column(node: Call, s: Series, names: dict[Expr, str]) -> Column:
        op = CATALOGUE.get(node.op)
        args = [F.col(names[a]) for a in node.args]
        return COMPILE[op.base_name](s, *([op.window] if op.has_window else []), *args)


def evaluate(df: DataFrame, expr: Expr | str, keys: tuple[str, ...], order: tuple[str, ...], name: str = "feature", **options) -> DataFrame:
    return SeriesFrame(df, keys, order).with_features({name: expr}, **options)


__all__ = ["CATALOGUE", "SeriesFrame", "Var", "evaluate", "register_operator"]
