"""From formula trees to plans: layers of window columns, for Spark or as SQL.

Equal sub-trees are one column. Window operators of one depth make one layer, so that all time
windows of a layer share one exchange by code and all cross-sections one by date.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.formula import FormulaError, Node, columns, parse
from lodestrand.functions.panel_ops import OPS, clean
from lodestrand.sources.panel import check_columns

# Columns that formulas may name and a panel need not have.
DERIVED = {"vwap": "COALESCE(amount / volume, (open + high + low + close) / 4)", "returns": "RET(close, 1)"}


def tree(formula: str | Node) -> Node:
    """A formula's tree with derived columns put in and numbers in their places."""
    node = parse(formula) if isinstance(formula, str) else formula
    return _bind(node)


def _bind(node: Node) -> Node:
    if node[0] == "col":
        return _bind(parse(DERIVED[node[1]])) if node[1] in DERIVED else node
    if node[0] == "num":
        return node
    _, name, *args = node
    if name not in OPS:
        raise FormulaError(f"unknown operator {name}")
    op = OPS[name]
    out: list[Node] = []
    for k, a in enumerate(args):
        if k in op.numbers:
            if a[0] != "num":
                raise FormulaError(f"argument {k + 1} of {name} has to be a number")
            first = op.kind == "time" and k == op.numbers[0] or name in ("SMA", "LASTZ")
            low = a[1] if name in ("DELAY", "DELTA", "RET") else max(1, a[1])
            out.append(("num", int(floor(low))) if first else a)
        else:
            out.append(_bind(a))
    if name == "POW" and out[1][0] == "num":
        p, base = out[1][1], out[0]
        if p == 1:
            return base
        if p == 2:
            return ("call", "MUL", base, ("call", "ABS", base))
        if p == 0.5:
            return ("call", "MUL", ("call", "SIGN", base), ("call", "SQRT", ("call", "ABS", base)))
    return ("call", name, *out)


def lookback(node: Node) -> int:
    """Rows before the first that a formula needs: what a loader has to read beyond the wanted range."""
    if node[0] != "call":
        return 0
    op = OPS[node[1]]
    own = op.back(*(node[2 + k][1] for k in op.numbers if 2 + k < len(node))) if op.kind == "time" else 0
    return own + max((lookback(a) for a in node[2:]), default=0)


def rounded(x, digits: int = 6):
    """A result to some places, ties away from zero whatever the last bits are."""
    return F.round(x + F.signum(x) * 1e-10, digits)


def sql_rounded(x: str, digits: int = 6) -> str:
    return f"round(CASE WHEN isfinite({x}) THEN {x} + sign({x}) * 1e-10 END, {digits})"


class _Plan:
    """Window nodes by depth, and the row expressions that they read, each with a column name."""

    def __init__(self, outputs: dict[str, Node]):
        self.names: dict[Node, str] = {}
        self.depths: dict[Node, int] = {}
        self.layers: list[list[Node]] = []
        self.arguments: list[list[Node]] = []
        for node in outputs.values():
            self.visit(node)

    def visit(self, node: Node) -> int:
        if node in self.depths:
            return self.depths[node]
        if node[0] != "call":
            return 0
        op = OPS[node[1]]
        own = [a for k, a in enumerate(node[2:]) if k not in op.numbers]
        depth = max((self.visit(a) for a in own), default=0)
        if op.kind != "row":
            for a in own:
                if a[0] == "num" or a[0] == "call" and OPS[a[1]].kind == "row":
                    at = self.depths.get(a, 0)
                    while len(self.arguments) <= at:
                        self.arguments.append([])
                    if a not in self.names:
                        self.names[a] = f"_k{len(self.names)}"
                        self.arguments[at].append(a)
            depth += 1
            while len(self.layers) < depth:
                self.layers.append([])
            self.names[node] = f"_k{len(self.names)}"
            self.layers[depth - 1].append(node)
        self.depths[node] = depth
        return depth


def _express(node: Node, names: dict[Node, str], leaf, number, apply, own: bool = False):
    if not own and node in names:
        return leaf(names[node])
    if node[0] == "col":
        return leaf(node[1])
    if node[0] == "num":
        return number(node[1])
    op = OPS[node[1]]
    args = [a[1] if k in op.numbers else _express(a, names, leaf, number, apply) for k, a in enumerate(node[2:])]
    return apply(op, args)


def compute(panel: DataFrame, formulas: dict[str, str | Node], digits: int | None = None) -> DataFrame:
    """(date, code, a column for each formula). Missing columns and unreadable formulas raise before any job."""
    trees = {k: tree(f) for k, f in formulas.items()}
    check_columns(panel, ["date", "code", *sorted(set().union(*map(columns, trees.values())))])
    plan = _Plan(trees)
    spark = lambda node, own=False: _express(node, plan.names, F.col, lambda v: F.lit(float(v)), lambda op, a: op.spark(*a), own)
    df = panel.select("date", "code", *sorted(set().union(*map(columns, trees.values())) - {"date", "code"}))
    for k in range(max(len(plan.layers), len(plan.arguments))):
        if k < len(plan.arguments) and plan.arguments[k]:
            done = [n for n in plan.arguments[k]]
            names, fresh = plan.names, {n: plan.names[n] for n in done}
            plan.names = {n: c for n, c in names.items() if n not in fresh}
            df = df.select("*", *[spark(n).alias(fresh[n]) for n in done])
            plan.names = names
        if k < len(plan.layers):
            df = df.select("*", *[spark(n, True).alias(plan.names[n]) for n in plan.layers[k]])
    value = lambda c: rounded(clean(c), digits) if digits is not None else clean(c)
    return df.select("date", "code", *[value(spark(n).cast("double")).alias(k) for k, n in trees.items()])


def to_sql(panel_sql: str, formulas: dict[str, str | Node], digits: int | None = 6, where: str = "") -> str:
    """The same as :func:`compute` in one SQL statement over any table expression of a panel."""
    trees = {k: tree(f) for k, f in formulas.items()}
    plan = _Plan(trees)
    sql = lambda node, own=False: _express(node, plan.names, str, lambda v: f"CAST({float(v)!r} AS DOUBLE)", lambda op, a: op.sql(*a), own)
    parts, last = [f"p0 AS ({panel_sql})"], "p0"
    for k in range(max(len(plan.layers), len(plan.arguments))):
        if k < len(plan.arguments) and plan.arguments[k]:
            names, fresh = plan.names, {n: plan.names[n] for n in plan.arguments[k]}
            plan.names = {n: c for n, c in names.items() if n not in fresh}
            parts.append(f"a{k} AS (SELECT *, {', '.join(f'{sql(n)} AS {c}' for n, c in fresh.items())} FROM {last})")
            plan.names, last = names, f"a{k}"
        if k < len(plan.layers):
            parts.append(f"w{k} AS (SELECT *, {', '.join(f'{sql(n, True)} AS {plan.names[n]}' for n in plan.layers[k])} FROM {last})")
            last = f"w{k}"
    value = (lambda x: f"(CASE WHEN isfinite({x}) THEN {x} END)") if digits is None else lambda x: sql_rounded(x, digits)
    out = ", ".join(f"{value(f'CAST({sql(n)} AS DOUBLE)')} AS {k}" for k, n in trees.items())
    return f"WITH {', '.join(parts)} SELECT date, code, {out} FROM {last}{where}"
