"""Column expressions: bands, local time, rounding and text forms of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.DoubleType, T.FloatType)


def round_to(value: Column, digits: int) -> Column:
    """Half-even rounding as array libraries do it: scale, rint, scale back."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def tier(total: Column, limits: Sequence[float] = (5, 99), names: Sequence[str] = ("Low", "Mid", "High")) -> Column:
    """First tier whose limit is not exceeded; the last one also takes missing totals."""
    out = F
    for limit, name in zip(limits, names):
        out = out.when(total <= F.lit(limit), F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Mapped value, or the value itself where the mapping is silent."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def threshold(prob: Column, tau: float | Column = 0.5) -> Column:
    return F.when(prob >= tau, 1).otherwise(0)


def local_time(epoch_ms: Column, zone: str) -> Column:
    """Wall-clock timestamp in ``zone``, whatever the session's zone is."""
    seconds = (epoch_ms / F.lit(1000)).cast("decimal(18,6)")
    zero = F.lit(0)
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(zero, zero, zero, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def context_time(df: DataFrame, epoch_ms: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """Adds ``ctx_hour`` and ``ctx_dayofweek`` (Monday is 0)."""
    wall = local_time(F.col(epoch_ms), zone)
    return df.withColumns({"ctx_hour": F.hour(wall), "ctx_dayofweek": F.weekday(wall)})


def duration_minutes(df: DataFrame, start: str, end: str, name: str = "live_duration_min") -> DataFrame:
    """Minutes between two epoch-millisecond columns; a negative span is missing."""
    minutes = (F.col(end) - F.col(start)) / F.lit(60000.0)
    return df.withColumn(name, F.when(minutes >= 0, round_to(minutes, 1)))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace missing values; each column keeps its type."""
    types = {field.name: field.dataType for field in df.schema.fields}
    filled = {}
    for name, value in defaults.items():
        value = value if isinstance(value, Column) else F.lit(value)
        filled[name] = F.coalesce(F.col(name), value.cast(types[name]))
    return df.withColumns(filled)


def decimal_text(value: Column) -> Column:
    """Shortest text of a double: plain digits from 1e-4 up to 1e16, exponent outside.

    Same as Python's below 1e16; from there on, older Java versions may print a digit more.
    """
    java = value.cast("string")
    magnitude = F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(java.cast("decimal(38,21)").cast("string"), "0+$", ""), "\\.$", ".0")
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), "\\.0$", "")
    power = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    exponent = F.concat(
        mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    return (
        F.when(F.isnan(value), "nan")
        .when((value == 0) | ((magnitude >= 1e-3) & (magnitude < 1e7)), java)
        .when((magnitude >= 1e-4) & (magnitude < 1e16), plain)
        .when(magnitude == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .otherwise(exponent)
    )


def value_text(name: str, dtype: T.DataType) -> Column:
    """Text of a feature value in prompts and category levels; missing prints ``nan``."""
    column = F.col(name)
    text = decimal_text(column.cast("double")) if isinstance(dtype, FRACTIONAL) else column.cast("string")
    return F.coalesce(text, F.lit("nan"))


def strip_text(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def normalize_text(text: Column, limit: int | None = None) -> Column:
    """Trimmed single line. With a limit: runs of blanks collapse and long text is cut."""
    if limit is None:
        return F.replace(strip_text(text), F.lit("\n"), F.lit(" "))
    flat = F.regexp_replace(strip_text(text), "\\s+", " ")
    return F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(" ..."))).otherwise(flat)
