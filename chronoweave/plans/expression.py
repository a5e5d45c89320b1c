"""Immutable expressions: parse, print, generate and change."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from ..functions.catalogue import Catalogue, Operator

MAX_DEPTH = 4


class Expr:
    """A node. Equal expressions compare equal and hash alike."""

    @property
    def children(self) -> tuple[Expr, ...]:
        return ()

    def depth(self) -> int:
        return max((c.depth() + 1 for c in self.children), default=0)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def nodes(self) -> Iterator[Expr]:
        """Parents before children."""
        yield self
        for c in self.children:
            yield from c.nodes()

    def paths(self, at: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Expr]]:
        yield at, self
        for i, c in enumerate(self.children):
            yield from c.paths((*at, i))

    def variables(self) -> set[str]:
        return {n.name for n in self.nodes() if isinstance(n, Var)}

    def replace(self, path: tuple[int, ...], new: Expr) -> Expr:
        """A copy with the node at ``path`` exchanged; twins elsewhere stay."""
        if not path:
            return new
        kids = list(self.children)
        kids[path[0]] = kids[path[0]].replace(path[1:], new)
        return Call(self.op, tuple(kids))


@dataclass(frozen=True)
class Var(Expr):
    name: str

    def __str__(self) -> str:
        return self.name if re.fullmatch(r"[A-Za-z_][A-Za-z_0-9.]*", self.name) else "`" + self.name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Const(Expr):
    value: float

    def __str__(self) -> str:
        return repr(float(self.value))


@dataclass(frozen=True)
class Call(Expr):
    op: str
    args: tuple[Expr, ...]

    @property
    def children(self) -> tuple[Expr, ...]:
        return self.args

    def __str__(self) -> str:
        return f"{self.op}({', '.join(map(str, self.args))})"


_TOKEN = re.compile(r"\s*(?:(?P<num>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|`(?P<quoted>(?:[^`]|``)+)`|(?P<name>[A-Za-z_][A-Za-z_0-9.]*)|(?P<mark>[(),]))")


def parse(text: str, catalogue: Catalogue | None = None) -> Expr:
    """Read ``op(arg, ...)``; the inverse of ``str``. Operators and the number of their
    arguments are checked."""
    catalogue = catalogue or Catalogue()
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))

    def read(i: int) -> tuple[Expr, int]:
        kind, value = tokens[i]
        if kind == "num":
            return Const(float(value)), i + 1
        if kind == "quoted":
            return Var(value.replace("``", "`")), i + 1
        if kind != "name":
            raise ValueError(f"unexpected {value!r} in {text!r}")
        if tokens[i + 1] != ("mark", "("):
            return Var(value), i + 1
        args, i = [], i + 2
        while True:
            arg, i = read(i)
            args.append(arg)
            i += 1
            if tokens[i - 1] == ("mark", ")"):
                break
            if tokens[i - 1] != ("mark", ","):
                raise ValueError(f"expected , or ) in {text!r}")
        if value not in catalogue:
            raise ValueError(f"no operator {value!r}")
        if catalogue.get(value).arity != len(args):
            raise ValueError(f"{value} takes {catalogue.get(value).arity} arguments")
        return Call(value, tuple(args)), i

    out, end = read(0)
    if tokens[end][0] != "end":
        raise ValueError(f"text after the expression in {text!r}")
    return out


def leaf(rng: random.Random, variables: Sequence[str], p_constant: float = 0.2) -> Expr:
    """A variable, or with p_constant (and where there are none) a constant on a grid of
    ten-thousandths from -1 to 1."""
    kinds = ["constant", "variable"] if variables else ["constant"]
    kind, *_ = rng.choices(kinds, [p_constant, 1 - p_constant][: len(kinds)] if variables else None)
    return Var(rng.choice(variables)) if kind == "variable" else Const(rng.randint(-10_000, 10_000) / 10_000)


def grow(catalogue: Catalogue, variables: Sequence[str], max_depth: int = MAX_DEPTH, *, rng: random.Random, p_constant: float = 0.2, p_leaf: float = 0.3) -> Expr:
    """A random expression whose root is an operator and whose branches end early with
    probability p_leaf."""

    def below(left: int) -> Expr:
        if left == 0 or rng.random() < p_leaf:
            return leaf(rng, variables, p_constant)
        return node(left)

    def node(left: int) -> Expr:
        op = catalogue.sample(rng=rng)
        return Call(op.name, tuple(below(left - 1) for _ in range(op.arity)))

    return node(max_depth) if max_depth else leaf(rng, variables, p_constant)


def grow_full(catalogue: Catalogue, variables: Sequence[str], target_depth: int = MAX_DEPTH, *, rng: random.Random, p_constant: float = 0.2) -> Expr:
    """A random expression whose branches all reach the depth."""
    return grow(catalogue, variables, target_depth, rng=rng, p_constant=p_constant, p_leaf=0.0)


class Mutator:
    """Random changes of an expression, one at a time, within the depth bound. Rules list
    what may stand in a node's place; a change is one of all that a rule allows anywhere in
    the tree, each as likely as the other. Where it allows none, the tree stays."""

    def __init__(self, catalogue: Catalogue, variables: Sequence[str], max_depth: int = MAX_DEPTH, seed: int | None = None):
        self.catalogue, self.names, self.max_depth, self.rng = catalogue, list(variables), max_depth, random.Random(seed)

    def _change(self, tree: Expr, rule: Callable[[Expr], list[Expr]]) -> Expr:
        steps = [(path, new) for path, node in tree.paths() for new in rule(node)]
        return tree.replace(*self.rng.choice(steps)) if steps else tree

    def _called(self, node: Expr, test: Callable[[Operator, Operator], bool]) -> list[Expr]:
        """The call with every other operator that the test lets stand for its own."""
        if not isinstance(node, Call):
            return []
        own = self.catalogue.get(node.op)
        return [Call(o.name, node.args) for o in self.catalogue.by_arity(own.arity) if o.name != own.name and test(own, o)]

    def swap_operator(self, tree: Expr) -> Expr:
        """Another operator of the same family and arity, else of the same arity."""
        return self._change(tree, lambda n: self._called(n, lambda own, o: o.family is own.family) or self._called(n, lambda own, o: True))

    def resize_window(self, tree: Expr) -> Expr:
        return self._change(tree, lambda n: self._called(n, lambda own, o: own.has_window and o.has_window and o.base_name == own.base_name))

    def swap_variable(self, tree: Expr) -> Expr:
        """Any other of the variables given, in the tree or not."""
        return self._change(tree, lambda n: [Var(v) for v in self.names if v != n.name] if isinstance(n, Var) else [])

    def graft(self, tree: Expr) -> Expr:
        path, _ = self.rng.choice(list(tree.paths()))
        return tree.replace(path, grow(self.catalogue, self.names, self.max_depth - len(path), rng=self.rng))

    def mutate(self, tree: Expr) -> Expr:
        return self.rng.choice([self.swap_operator, self.resize_window, self.swap_variable, self.graft])(tree)
