"""Parsing text cells: every parser returns NULL for what it cannot read and never fails a job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake import constants as C

FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(cell: Column) -> Column:
    """A cell without white space around it, of any script; trim() knows the blank alone."""
    return F.regexp_replace(cell, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def maybe_float(cell: Column) -> Column:
    """A finite number, or NULL for blanks, words, infinities and NaN."""
    number = F.when(stripped(cell).rlike(FLOAT), stripped(cell).try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def maybe_int(cell: Column) -> Column:
    """A whole number without a decimal point that fits 64 bits, or NULL."""
    text = stripped(cell)
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def age_years(cell: Column) -> Column:
    """Whole years; the mask for high ages becomes its agreed value."""
    text = stripped(cell)
    return F.when(text == C.AGE_MASK_TOKEN, F.lit(C.AGE_MASK_VALUE)).otherwise(maybe_int(text).cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is zero."""
    return F.try_divide(part.cast("double"), whole)


def within(value: Column, low: float, high: float) -> Column:
    """The value if it lies in the closed window, else NULL; it is never clipped."""
    return F.when(value.between(low, high), value)


def fio2_fraction(value: Column) -> Column:
    """A fraction of oxygen; percentages are divided by 100. The fraction's window is tried first."""
    (a, b), (c, d) = C.WINDOW_FIO2_FRACTION, C.WINDOW_FIO2_PERCENT
    return F.when(value.between(a, b), value).when(value.between(c, d), value / 100.0)


def celsius(value: Column) -> Column:
    """A temperature in degrees Celsius; Fahrenheit is converted. Both windows are open."""
    (a, b), (c, d) = C.WINDOW_TEMP_C, C.WINDOW_TEMP_F
    return F.when((value > a) & (value < b), value).when((value > c) & (value < d), (value - 32.0) * 5.0 / 9.0)


def sentinel_cell(cell: Column, kind: str = "plain") -> Column:
    """STRUCT<value, status> of a cell in which -1 stands for missing.

    status: empty, minus_one, other_negative, unparseable, out_of_window or ok, one of them for each cell. kind 'fio2'
    and 'temperature' bring units together; what lies in neither window has no value.
    """
    unit = {"fio2": fio2_fraction, "temperature": celsius}.get(kind, lambda x: x)

    def judged(text: Column, number: Column, value: Column) -> Column:
        status = (
            F.when(text == "", "empty").when(number.isNull(), "unparseable").when(number == C.SENTINEL_MISSING, "minus_one")
            .when(number < 0, "other_negative").when(value.isNull(), "out_of_window").otherwise("ok")
        )
        return F.struct(F.when((number >= 0) & value.isNotNull(), value).alias("value"), status.alias("status"))

    return _parsed(cell, unit, judged)


def _parsed(cell: Column, unit: Callable[[Column], Column], judged: Callable[[Column, Column, Column], Column]) -> Column:
    """What is judged of a cell's text, number and value in the unit asked for; each is computed once."""
    return let(
        F.coalesce(stripped(cell), F.lit("")),
        lambda text: let(
            F.when(text.rlike(FLOAT), text.try_cast("double")),
            lambda raw: let(F.when(F.abs(raw) < float("inf"), raw), lambda number: let(unit(number), lambda value: judged(text, number, value))),
        ),
    )


def windowed_cell(cell: Column, low: float, high: float, factor: float = 1.0) -> Column:
    """STRUCT<value, status> of a cell times factor; status: empty, unparseable, out_of_window or ok."""

    def judged(text: Column, number: Column, value: Column) -> Column:
        status = F.when(text == "", "empty").when(number.isNull(), "unparseable").when(value.isNull(), "out_of_window").otherwise("ok")
        return F.struct(value.alias("value"), status.alias("status"))

    return _parsed(cell, lambda x: within(x * factor if factor != 1.0 else x, low, high), judged)


def one_hot(cell: Column, name: str, levels: tuple[str, ...]) -> dict[str, Column]:
    """A column of 0.0 or 1.0 for each level; a level named OTHER takes all that is not listed, '' is named EMPTY."""
    text = F.coalesce(stripped(cell), F.lit(""))
    listed = [v for v in levels if v != "OTHER"]
    out = {f"{name}={v or 'EMPTY'}": (text == v).cast("double") for v in listed}
    if "OTHER" in levels:
        out[f"{name}=OTHER"] = (~text.isin(listed)).cast("double")
    return out


def missing_pair(value: Column, name: str) -> dict[str, Column]:
    """The value and its indicator of being missing."""
    return {name: value, f"{name}__missing": value.isNull().cast("double")}
