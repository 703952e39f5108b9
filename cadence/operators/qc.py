"""Station reports: packed values, quality flags, timestamps, one value for each station-hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.clock import hour_floor

#: Fixed values of the report format.
GOOD_FLAGS = ("1", "5", "C", "I", "M", "P", "R", "U")
MISSING = "+9999"
LOW, HIGH = -60.0, 60.0
_NUMBER = r"^\s*[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?\s*$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def number(text: Column) -> Column:
    """Of a text that is one, else NULL; the cast alone would take more than numbers."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def report_time(text: Column, honour_offset: bool) -> Column:
    """NTZ in UTC of an ISO date or time, else NULL; an offset shifts the time or is ignored."""
    gated = F.when(text.rlike(_ISO), text)
    if not honour_offset:
        gated = F.regexp_replace(gated, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
        gated = F.when(F.length(gated) >= 10, gated).otherwise(F.when(text.rlike(_ISO), text))
    return F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(gated), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def strict_fields(packed: Column) -> tuple[Column, Column]:
    """Value and flag, split at the first comma; what follows it is the flag."""
    parts = F.split(packed, ",", 2)
    return number(F.get(parts, F.lit(0))) / 10, F.trim(F.get(parts, F.lit(1)))


def unquoted(packed: Column) -> Column:
    return F.trim(F.translate(packed, "\"'", ""))


def one_comma(packed: Column) -> Column:
    return F.length(packed) - F.length(F.replace(packed, F.lit(","), F.lit(""))) == 1


def row_class(packed: Column) -> tuple[Column, Column]:
    """(class, value): na_input, malformed, missing, qc_reject, phys_reject or valid, each row one of them; the value of valid rows."""
    text = unquoted(packed)
    parts = F.split(text, ",")
    value_text, flag = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    value = number(value_text) / 10
    kind = (
        F.when(packed.isNull() | (text == ""), "na_input")
        .when(~one_comma(text), "malformed")
        .when(value_text == MISSING, "missing")
        .when(value.isNull(), "malformed")
        .when(~flag.isin(*GOOD_FLAGS), "qc_reject")
        .when(~value.between(LOW, HIGH), "phys_reject")
        .otherwise("valid")
    )
    return kind, F.when(kind == "valid", value)


def strict_readings(reports: DataFrame, packed: str = "TMP", date: str = "DATE") -> DataFrame:
    """``reports`` with value, time and accepted, by the strict rules: first comma, whitelisted flag, range, offsets honoured."""
    value, flag = strict_fields(F.col(packed))
    time = report_time(F.col(date), True)
    ok = value.isNotNull() & F.coalesce(flag.isin(*GOOD_FLAGS), F.lit(False)) & value.between(LOW, HIGH) & time.isNotNull()
    return reports.withColumns({"value": value, "time": time, "accepted": F.coalesce(ok, F.lit(False))})


def scheme_readings(reports: DataFrame, packed: str = "TMP", date: str = "DATE") -> DataFrame:
    """``reports`` with row_class, value, time and accepted, by the rules of the scheme comparison and the inventory: exactly one comma, offsets ignored."""
    kind, value = row_class(F.col(packed))
    time = report_time(F.col(date), False)
    return reports.withColumns({"row_class": kind, "value": value, "time": time, "accepted": (kind == "valid") & time.isNotNull()})


def hourly_mean(readings: DataFrame, keys: list[str], value: str = "value", time: str = "time") -> DataFrame:
    """One row for each key and UTC hour with the mean of its values as obs; a third of rows under one key meet only after partial sums."""
    return readings.groupBy(*keys, hour_floor(F.col(time)).alias("time")).agg(F.avg(value).alias("obs"))
