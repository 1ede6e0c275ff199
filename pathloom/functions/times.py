"""Log times to epoch seconds. Sessions must run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}(\.\d+)?"


def _cast(text: Column, shape: str) -> Column:
    """Seconds of a text of that shape: a bare cast would also take a year alone."""
    return F.when(text.rlike(shape), F.unix_seconds(F.try_to_timestamp(text)))


def event_log_seconds(text: Column) -> Column:
    """`Y-m-d H:M:S[.f]` or `Y-m-dTH:M:S[.f]Z`; else 0."""
    return F.coalesce(_cast(text, f"{_DATE}( {_CLOCK}|T{_CLOCK}Z)$"), F.lit(0).cast("bigint"))


def rfc3339_seconds(text: Column) -> Column:
    """RFC 3339 with Z or an offset, any fraction, and the same without a zone; null if it is none."""
    return _cast(text, rf"{_DATE}[T ]{_CLOCK}(Z|[+-]\d{{2}}:\d{{2}})?$")


def cloud_seconds(text: Column) -> Column:
    return F.coalesce(rfc3339_seconds(text), F.lit(0).cast("bigint"))


def generic_seconds(text: Column) -> Column:
    """As rfc3339_seconds(), or an epoch integer taken as it is; else 0."""
    return F.coalesce(rfc3339_seconds(text), F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def hour_of(seconds: Column) -> Column:
    """Start of the hour; truncates towards 0 for negative seconds."""
    return seconds - seconds % 3600
