"""Arithmetic expressions over columns, and contrasts of conditions given as such expressions.

An expression is read by Python's own ``ast`` and becomes one Spark column, so nothing is evaluated row by row.
"""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.functions.series import contrast_vector

BINARY: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: lambda a, b: remainder(a, b), ast.Pow: lambda a, b: F.pow(_column(a), _column(b))}
UNARY: dict[type, Callable] = {ast.USub: operator.neg, ast.UAdd: operator.pos}


def _column(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def remainder(a: object, b: object) -> object:
    """With the divisor's sign, as the expressions' language has it; null for a divisor of 0."""
    if not isinstance(a, Column) and not isinstance(b, Column):
        return a % b if b else F.lit(None).cast("double")
    x, y = _column(a), _column(b)
    rest = x % F.nullif(y, F.lit(0))
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)


def frexp(x: Column) -> Column:
    """Struct (m, e): x = m * 2^e with m in [0.5, 1); (x, 0) for 0 and what isn't finite."""
    x = x.cast("double")
    size = F.abs(x)
    odd = (x == 0) | F.isnan(x) | (size == float("inf"))
    near = F.when(odd, 0).otherwise(F.floor(F.log2(F.when(odd, 1.0).otherwise(size))) + 1).cast("int")
    # halved first: 2^1024 is no double
    m = size / F.pow(F.lit(2.0), (near - 1).cast("double")) / 2
    # the logarithm may round across a power of two
    off = F.when(m >= 1, 1).when(m < 0.5, -1).otherwise(0)
    part = F.signum(x) * m * F.pow(F.lit(2.0), -off.cast("double"))
    return F.struct(F.when(odd, x).otherwise(part).alias("m"), F.when(odd, 0).otherwise(near + off).cast("int").alias("e"))


def ldexp(m: Column, e: Column) -> Column:
    """m * 2^e, by two factors, as either half of the exponent is in range."""
    half = F.floor(e / 2)
    return m.cast("double") * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (e - half).cast("double"))


def modf(x: Column) -> Column:
    """Struct (part, whole): the fraction and the whole part, both with the sign of x."""
    x = x.cast("double")
    endless = F.abs(x) == float("inf")
    # a double of 2^52 or more has no fraction, and its whole part may be beyond a long
    whole = F.when(F.abs(x) >= 2.0**52, x).otherwise(F.signum(x) * F.floor(F.abs(F.when(F.abs(x) < 2.0**52, x))).cast("double"))
    return F.struct(F.when(endless, F.signum(x) * 0.0).otherwise(x - whole).alias("part"), whole.alias("whole"))


class ExpressionSyntaxError(ValueError):
    """The text is no arithmetic expression."""


class ExpressionNameError(ValueError):
    """``names``: the variables and functions that the expression needs and doesn't have."""

    def __init__(self, expression: str, names: list[str]):
        super().__init__(f"undefined in {expression!r}: {', '.join(names)}")
        self.names = names


class ArithmeticExpression:
    """``expression`` with variables that are columns, numbers or functions that give one of them.

    Names are taken from the variables only, never from a table, so a column has to be passed under its name.
    """

    def __init__(self, expression: str, **variables: object):
        self.expression, self.variables = expression, dict(variables)
        self.functions: dict[str, Callable] = {}

    def add_default_functions(self) -> ArithmeticExpression:
        for name in ("abs", "acos", "asin", "atan", "ceil", "cos", "cosh", "degrees", "exp", "floor", "log", "log10", "radians", "sin", "sinh", "sqrt", "tan", "tanh"):
            self.functions[name] = lambda x, own=getattr(F, name): own(_column(x))
        for name in ("atan2", "hypot", "pow"):
            self.functions[name] = lambda x, y, own=getattr(F, name): own(_column(x), _column(y))
        for name, own in {"fabs": lambda x: F.abs(x.cast("double")), "frexp": frexp, "modf": modf}.items():
            self.functions[name] = lambda x, own=own: own(_column(x))
        for name, own in {"fmod": lambda x, y: x.cast("double") % F.nullif(y.cast("double"), F.lit(0.0)), "ldexp": ldexp}.items():
            self.functions[name] = lambda x, y, own=own: own(_column(x), _column(y))
        return self

    def add_default_variables(self) -> ArithmeticExpression:
        self.variables |= {"pi": math.pi, "e": math.e}
        return self

    def _tree(self) -> ast.expr:
        try:
            return ast.parse(self.expression.strip(), mode="eval").body
        except SyntaxError as error:
            raise ExpressionSyntaxError(f"{self.expression!r}, at {error.offset}: {error.msg}") from error

    def check(self) -> None:
        """Raise if the text is no arithmetic expression, or names all that it lacks."""
        tree = self._tree()
        calls = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
        names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - calls
        missing = sorted(names - self.variables.keys()) + sorted(calls - self.functions.keys())
        if missing:
            raise ExpressionNameError(self.expression, missing)
        self._value(tree)

    def evaluate(self) -> Column:
        self.check()
        return _column(self._value(self._tree()))

    def _value(self, node: ast.expr):
        match node:
            case ast.Constant(value=int() | float() as number):
                return number
            case ast.Name(id=name):
                found = self.variables[name]
                return found() if callable(found) and not isinstance(found, Column) else found
            case ast.BinOp(left=left, op=op, right=right) if type(op) in BINARY:
                return BINARY[type(op)](self._value(left), self._value(right))
            case ast.UnaryOp(op=op, operand=operand) if type(op) in UNARY:
                value = self._value(operand)
                return value if isinstance(op, ast.UAdd) else UNARY[type(op)](value)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return self.functions[name](*[self._value(a) for a in args])
        raise ExpressionSyntaxError(f"no arithmetic in {self.expression!r}: {ast.unparse(node)}")


def compute_contrasts(levels: DataFrame, contrasts: dict[str, str], covariances: DataFrame | None = None) -> DataFrame:
    """(voxel, contrast, value[, variance]) of linear expressions of conditions.

    ``levels``: voxel, condition, value; ``covariances``: voxel, c1, c2, value, both orders of a pair given. The
    coefficients are part of the plan; each table is aggregated once by voxel and neither is joined with conditions.
    """
    conditions = _conditions(contrasts, levels)
    vectors = {name: dict(zip(conditions, contrast_vector(text, conditions), strict=True)) for name, text in contrasts.items()}

    def weight(vector: dict[str, float], column: str) -> Column:
        out = F.lit(0.0)
        for c, w in vector.items():
            if w:
                out = F.when(F.col(column) == c, w).otherwise(out)
        return out

    def tall(wide: DataFrame, value: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("contrast"), F.col(f"_{i}").alias(value)) for i, n in enumerate(vectors)])
        return wide.select("voxel", F.explode(cells).alias("e")).select("voxel", f"e.contrast", f"e.{value}")

    sums = levels.groupBy("voxel").agg(*[F.sum(weight(v, "condition") * F.col("value")).alias(f"_{i}") for i, v in enumerate(vectors.values())])
    out = tall(sums, "value")
    if covariances is None:
        return out
    squares = covariances.groupBy("voxel").agg(*[F.sum(weight(v, "c1") * weight(v, "c2") * F.col("value")).alias(f"_{i}") for i, v in enumerate(vectors.values())])
    return out.join(tall(squares, "variance"), ["voxel", "contrast"])


def _conditions(contrasts: dict[str, str], levels: DataFrame) -> list[str]:
    """Names of conditions that occur in the expressions: a design's few conditions."""
    known = sorted(r[0] for r in levels.select("condition").distinct().collect())
    return [c for c in known if any(c in text for text in contrasts.values())] or known


def contrast_classes(classes: DataFrame, contrasts: dict[str, str]) -> DataFrame:
    """(contrast, class, mean, variance) of the conditions' classes (condition, class, mean, variance), taken as independent."""
    conditions = sorted(r[0] for r in classes.select("condition").distinct().collect())
    out = None
    for name, text in contrasts.items():
        vector = dict(zip(conditions, contrast_vector(text, conditions), strict=True))
        w = F.lit(0.0)
        for c, x in vector.items():
            w = F.when(F.col("condition") == c, x).otherwise(w)
        one = classes.groupBy("class").agg(F.sum(w * F.col("mean")).alias("mean"), F.sum(w * w * F.col("variance")).alias("variance")).select(F.lit(name).alias("contrast"), "class", "mean", "variance")
        out = one if out is None else out.unionByName(one)
    return out
