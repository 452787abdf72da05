"""Tests of conditional independence for the graph search, by name.

A level of the search asks a table of questions: graph keys, the pair ``i < j``, the
conditioning positions ``z`` and the order ``ord`` in which a pair's sets are tried. A test
gets the questions and the graphs and returns the questions it finds independent. It may
read the graph's matrices or its sample; the search does not know which.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dayloom.operators import ccit


@dataclass(frozen=True)
class Asked:
    """What a test may look at: questions of one level, and graphs with ``keys``, ``n``,
    ``limit`` and the flat columns ``c`` (correlations), ``s`` (rank correlations) and
    ``x`` (the sample), each ``p`` wide."""

    questions: DataFrame
    graphs: DataFrame
    keys: list[str]
    p: int
    level: int
    alpha: float


TESTS: dict[str, Callable[[Asked], DataFrame]] = {}


def ci_test(name: str):
    """Registers a test: ``Asked`` -> the independent questions, all their columns kept."""

    def register(f):
        TESTS[name] = f
        return f

    return register


def partial_correlation(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y given one more variable, from their correlations; 0 / 0 is null."""
    rest = (1 - xz * xz) * (1 - yz * yz)
    return (xy - xz * yz) / F.nullif(F.sqrt(F.greatest(rest, F.lit(0.0))), F.lit(0.0))


def partial_correlation_given(at: Callable[[Column, Column], Column], x: Column, y: Column, z: Sequence[Column]) -> Column:
    """The same given any number of variables, one after the other; ``at`` reads a correlation."""
    if not z:
        return at(x, y)
    *rest, last = z
    given = lambda a, b: partial_correlation_given(at, a, b, rest)
    return partial_correlation(given(x, y), given(x, last), given(y, last))


def _by_matrix(asked: Asked, matrix: str) -> DataFrame:
    rows = asked.questions.join(asked.graphs.select(*asked.keys, F.col(matrix).alias("_m"), "limit"), asked.keys)
    at = lambda a, b: F.element_at("_m", (a * asked.p + b + 1).cast("int"))
    z = [F.element_at("z", k + 1) for k in range(asked.level)]
    r = partial_correlation_given(at, F.col("i"), F.col("j"), z)
    return rows.where(F.abs(r) <= F.col("limit")).select(*asked.questions.columns)


@ci_test("pearsonr")
def pearsonr(asked: Asked) -> DataFrame:
    """Partial Pearson correlation within the level's critical value."""
    return _by_matrix(asked, "c")


@ci_test("spearmanr")
def spearmanr(asked: Asked) -> DataFrame:
    """Partial correlation of ranks within the same critical value."""
    return _by_matrix(asked, "s")


@ci_test("ccit")
def classifier(asked: Asked) -> DataFrame:
    """Classifier two-sample test on each question's rows of the graph's sample."""
    sample = asked.graphs.select(*asked.keys, "x")
    rows = asked.questions.join(sample, asked.keys).withColumn("_row", F.explode(F.sequence(F.lit(0), (F.size("x") / asked.p - 1).cast("int"))))
    value = lambda v: F.element_at("x", (F.col("_row") * asked.p + v + 1).cast("int"))
    z = {f"_z{k}": value(F.element_at("z", k + 1)) for k in range(asked.level)}
    rows = rows.withColumns({"_x": value(F.col("i")), "_y": value(F.col("j")), **z})
    keys = [*asked.keys, "i", "j", "ord"]
    tested = ccit.classifier_tests(rows, "_x", "_y", list(z), row_id="_row", keys=keys)
    free = tested.where(F.col("p_val") >= asked.alpha).select(*keys)
    return asked.questions.join(free, keys, "left_semi")
