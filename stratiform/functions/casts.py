"""Typed values out of raw text. Bad input gives null, never a failed job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.functions.names import existing


def parse_decimal(text: Column, decimal_comma: bool = True) -> Column:
    """``"12 500,00"`` -> 12500.0; spaces (also no-break ones) are thousands marks."""
    plain = F.regexp_replace(text, r"[\s\x{00A0}\x{202F}]", "")
    if decimal_comma:
        plain = F.replace(plain, F.lit(","), F.lit("."))
    return plain.try_cast("double")


def excel_date(serial: Column) -> Column:
    """Date of a spreadsheet serial number (day 1 is 1900-01-01)."""
    days = serial.try_cast("double").cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), days)


def _typed(df: DataFrame, doubles, ints, dates, decimal_comma) -> dict[str, Column]:
    typed = {}
    for name in existing(doubles, df.columns):
        column = F.col(f"`{name}`")
        typed[name] = parse_decimal(column) if decimal_comma else column.try_cast("double")
    for name in existing(ints, df.columns):
        typed[name] = F.col(f"`{name}`").try_cast("int")
    for name in existing(dates, df.columns):
        typed[name] = F.try_to_date(F.col(f"`{name}`"), dates[name])
    return typed


def cast_columns(
    df: DataFrame,
    doubles: Iterable[str] = (),
    ints: Iterable[str] = (),
    dates: Mapping[str, str] | None = None,
    decimal_comma: bool = False,
) -> DataFrame:
    """All casts in one projection; columns that are absent are skipped."""
    return df.withColumns(_typed(df, doubles, ints, dates or {}, decimal_comma))


def cast_failures(
    df: DataFrame,
    doubles: Iterable[str] = (),
    ints: Iterable[str] = (),
    dates: Mapping[str, str] | None = None,
    decimal_comma: bool = False,
) -> DataFrame:
    """``(colonne, nb_non_null, nb_echecs)``: values lost by ``cast_columns``, in one scan."""
    typed = _typed(df, doubles, ints, dates or {}, decimal_comma)
    measures = []
    for name, column in typed.items():
        raw = F.col(f"`{name}`")
        measures += [
            F.count(raw).alias(f"n:{name}"),
            F.count_if(raw.isNotNull() & column.isNull()).alias(f"e:{name}"),
        ]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("colonne"),
                    F.col(f"`n:{name}`").alias("nb_non_null"),
                    F.col(f"`e:{name}`").alias("nb_echecs"),
                )
                for name in typed
            ]
        )
    )
    return df.agg(*measures).select(rows.alias("r")).select("r.*")


def cast_code_columns(df: DataFrame) -> DataFrame:
    """Columns named by a leading number hold pay-element amounts: cast them to double."""
    codes = [name for name in df.columns if name[:1].isdigit()]
    return cast_columns(df, doubles=codes)


def to_strings(df: DataFrame) -> DataFrame:
    """Bronze form: every column as text, null stays null, one projection."""
    return df.select([F.col(f"`{name}`").cast("string").alias(name) for name in df.columns])


def clip_negative(amount: Column) -> Column:
    return F.when(amount < 0, F.lit(0).cast("double")).otherwise(amount)


def recode(value: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Value recoding; unlisted values keep ``default`` (null when not given)."""
    chosen = F.lit(None) if default is None else default
    for old, new in reversed(list(mapping.items())):
        chosen = F.when(value == F.lit(old), F.lit(new)).otherwise(chosen)
    return chosen


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Rounded percentage as double; an empty whole gives null."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole.cast("double")), digits)


def period_parts(df: DataFrame, period: str = "periode") -> DataFrame:
    """``annee`` and ``mois`` as text, out of a ``YYYY_MM`` period."""
    return df.withColumns({"annee": F.substring(period, 1, 4), "mois": F.substring(period, 6, 2)})


def date_parts(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns({"annee": F.year(date), "mois": F.month(date)})
