"""Row-level expressions. All are Catalyst columns, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def day(c: str | Column) -> Column:
    """Calendar day of a date, timestamp or string; unreadable text gives null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("date")


def number_or_zero(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def first_truthy(*names: str) -> Column:
    """First operand that is null or non-zero, else the last operand."""
    *head, tail = [F.col(n) for n in names]
    out = tail
    for c in reversed(head):
        out = F.when(c.isNull() | (c != 0), c).otherwise(out)
    return out


def item_sum(names: list[str]) -> Column:
    """Sum that is null as soon as one item is null."""
    return reduce(add, [F.col(n) for n in names])


def natural_log(c: str) -> Column:
    """ln with ln(0) = -infinity; negative input gives null."""
    x = F.col(c)
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def zero_like(c: str) -> Column:
    return F.col(c) - F.col(c)


def mannequin_stress(c: str) -> Column:
    """Codes 1-2 -> 1, 3-6 -> 0, anything else unchanged."""
    x = F.col(c)
    return F.when(x.isin(1, 2), 1).when(x.isin(3, 4, 5, 6), 0).otherwise(x)


def control_bin(c: str) -> Column:
    """Quarter of a 0-100 control score, highest quarter 0; null counts as 0."""
    x = F.col(c)
    return F.when(x >= 75, 0).when(x >= 50, 1).when(x >= 25, 2).when(x < 25, 3).otherwise(0)


def derived(c: str, rule: Callable[[Column], Column]) -> Column:
    """The caller's rule applied to a column."""
    return rule(F.col(c))


def any_shift(c: str) -> Column:
    """1 and 2 -> 1, 0 -> 0, anything else unchanged."""
    x = F.col(c)
    return F.when(x.isin(1, 2), 1.0).when(x == 0, 0.0).otherwise(x)


def two_to_one(c: str) -> Column:
    x = F.col(c)
    return F.when(x == 2, 1.0).otherwise(x)


def sign_code(c: str) -> Column:
    """1 -> 1, 0 -> -1, anything else (null too) -> 0."""
    x = F.col(c)
    return F.when(x == 1, 1.0).when(x == 0, -1.0).otherwise(0.0)


def two_sided_label(x: Column, hi: float, lo: float, reverse: bool = False) -> Column:
    """1 at or above ``hi``, 0 below ``lo``, null in between; ``reverse`` swaps 0 and 1."""
    top, bottom = (0, 1) if reverse else (1, 0)
    return F.when(x >= hi, top).when(x < lo, bottom)


def any_of(*names: str) -> Column:
    """1 if any flag is 1, 0 if all are 0, else null."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(n) == 1, F.lit(False)) for n in names])
    calm = reduce(lambda a, b: a & b, [F.coalesce(F.col(n) == 0, F.lit(False)) for n in names])
    return F.when(hit, 1.0).when(calm, 0.0)


def composite_stress(stressed: str, shift: str, control: str) -> Column:
    return number_or_zero(stressed) / 2 + number_or_zero(shift) / 2 + number_or_zero(control) / 3


def below(c: Column, cut: float) -> Column:
    """1 if below the cut; null counts as not below."""
    return F.coalesce((c < cut).cast("int"), F.lit(0))


def code_label(c: str, labels: list[str]) -> Column:
    """1-based code -> label; codes outside the list give null."""
    code = F.col(c).cast("int")
    return F.when(code >= 1, F.try_element_at(F.array(*[F.lit(x) for x in labels]), code))


def rename_value(c: str, names: dict[str, str]) -> Column:
    """Look a code up in a fixed map; unknown codes give null."""
    flat = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), F.col(c))


def gain_loss_code(c: str) -> Column:
    return F.when(F.col(c) == "Gain", 0).when(F.col(c) == "Loss", 1)


def is_decreasing(before: Column, after: Column) -> Column:
    return (after <= before).cast("int")


def threshold_flag(x: Column, cut: float) -> Column:
    return F.when(x >= cut, 1).otherwise(0)


def quartile_bin(p: Column) -> Column:
    """Right-closed bins of a percentile: lowest quarter, middle half, top quarter."""
    return F.when(p <= 0.25, 0.25).when(p <= 0.75, 0.75).when(p.isNotNull(), 1.0)


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson r as an aggregate over complete rows; null without spread or rows."""
    x, y = ((F.col(c) if isinstance(c, str) else c).cast("double") for c in (a, b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def md5_bits(key: Column, start: int = 1) -> Column:
    """32 reproducible bits of a key as a long: eight hex digits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), start, 8), 16, 10).cast("long")


def normal_from_md5(digest: Column, which: int) -> Column:
    """One of the four standard normal draws an md5 digest holds (Box-Muller)."""
    word = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    pair = 2 * (which // 2)
    u1 = (word(pair) + 1) / F.lit(4294967297.0)
    u2 = word(pair + 1) / F.lit(4294967296.0)
    angle = F.lit(6.283185307179586) * u2
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * (F.sin(angle) if which % 2 else F.cos(angle))
