"""Stress labels by name, for the graph search and the classifiers.

A label step adds ``label`` to a panel of filled days and changes nothing else. It reads
columns by role; ``columns`` says which column of a panel plays a role, so the same
definitions serve any panel. Percentiles are taken within the entity.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from dayloom import vocab
from dayloom.functions import scalars as fn
from dayloom.operators import panel


@dataclass(frozen=True)
class Setting:
    """Keys of the panel, columns of the roles, and the cuts: 1 from ``hi`` on, 0 below ``lo``."""

    entity: str
    date: str
    columns: Mapping[str, str] = field(default_factory=dict)
    hi: float = vocab.STRESS_CUTOFF
    lo: float = vocab.NO_STRESS_CUTOFF

    def at(self, role: str) -> str:
        return self.columns.get(role, role)

    def percentile_label(self, df: DataFrame, column: str, reverse: bool = False) -> DataFrame:
        return panel.percentile_label(df, column, "label", entity=self.entity, hi=self.hi, lo=self.lo, reverse=reverse)

    def back(self, df: DataFrame, role: str) -> DataFrame:
        """Adds ``_back``: the role's column, gaps of up to seven days filled from the day after."""
        w = panel.by_day(self.entity, self.date).rowsBetween(0, 7)
        return df.withColumn("_back", F.first(self.at(role), True).over(w))


def _total_stress(df: DataFrame, s: Setting) -> DataFrame:
    """Composite of stress, shift stress and control category."""
    total = fn.composite_stress(s.at("daily_stressed"), s.at("shift_stress"), s.at("control_cat"))
    return s.percentile_label(df.withColumn("_total", total), "_total").drop("_total")


def _control_cat(df: DataFrame, s: Setting) -> DataFrame:
    """The control score itself against the cuts."""
    return df.withColumn("label", fn.two_sided_label(F.col(s.at("daily_control")), s.hi, s.lo))


def _hrv_binary(df: DataFrame, s: Setting) -> DataFrame:
    """Low variability is stress."""
    return s.percentile_label(df, s.at("log_hrv"), reverse=True)


def _any_stress(df: DataFrame, s: Setting) -> DataFrame:
    """A reported flag or low variability; calm only if all four say so."""
    flags = [s.at(r) for r in ("daily_stressed", "daily_shifts", "shift_stress")]
    low = _hrv_binary(df, s).withColumnRenamed("label", "_hrv")
    return low.withColumn("label", fn.any_of(*flags, "_hrv")).drop("_hrv")


def _back_percentile(role: str):
    return lambda df, s: s.percentile_label(s.back(df, role), "_back").drop("_back")


def _back_flag(role: str):
    return lambda df, s: s.back(df, role).withColumnRenamed("_back", "label")


def _percentile(role: str):
    return lambda df, s: s.percentile_label(df, s.at(role))


def _flag(role: str):
    return lambda df, s: df.withColumn("label", F.col(s.at(role)))


RULES: dict[str, Callable[[DataFrame, Setting], DataFrame]] = {
    "total_stress": _total_stress, "control_cat": _control_cat, "hrv_binary": _hrv_binary, "any_stress": _any_stress,
    "ppe_6": _back_percentile("ppe_6"), "covid_past_24": _back_flag("covid_past_24"),
    **{r: _percentile(r) for r in ("daily_control", "pss4_score")},
    **{r: _flag(r) for r in ("daily_stressed", "daily_shifts", "shift_stress")},
}


def step(name: str, **setting) -> Callable[[DataFrame], DataFrame]:
    """Label step of a definition by name; ``setting`` as in ``Setting``."""
    if name not in RULES:
        raise KeyError(f"no label {name!r}; known: {', '.join(sorted(RULES))}")
    return lambda df: RULES[name](df, Setting(**setting))


def definitions(
    names: Sequence[str] = tuple(vocab.DEFINITIONS), features: str | Sequence[str] = "oura+surveys",
    columns: Mapping[str, str] | None = None, **setting,
) -> dict[str, tuple[list[str], Callable[[DataFrame], DataFrame]]]:
    """Input of ``graph_search.discover``: every label with the features, given by role or
    as a named set, that do not give it away."""
    columns = dict(columns or {})
    roles = features if isinstance(features, str) else list(features)
    return {
        n: ([columns.get(f, f) for f in vocab.resolve_features(roles, n)], step(n, columns=columns, **setting)) for n in names
    }
