"""Dates and times. Values are read by ``core.time``; the session's time zone holds."""

from __future__ import annotations

import re

from ..errors import QueryError
from .core import function, literal, number, numeric, time

UNITS = {"millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "microsecond"}
_SPAN = re.compile(r"(\d+)\s*(milliseconds?|ms|seconds?|s|minutes?|m|hours?|h|days?|d)", re.IGNORECASE)
_ISO = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", re.IGNORECASE)
_MS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def millis(span: str) -> int:
    """'10s', '1h30m', '15 minutes', 'PT1M' or a number of milliseconds."""
    span = span.strip()
    if span.isdecimal():
        out = int(span)
    elif m := _ISO.fullmatch(span):
        out = sum(int(x or 0) * k for x, k in zip(m.groups(), (86_400_000, 3_600_000, 60_000, 1000)))
    elif span and _SPAN.sub("", span).strip() == "":
        out = sum(int(n) * (1 if u.lower().startswith(("ms", "milli")) else _MS[u[0].lower()]) for n, u in _SPAN.findall(span))
    else:
        raise QueryError("arguments", "no duration", expression=span, suggestion="write it as '10s', '1h30m' or PT1M")
    if out <= 0:
        raise QueryError("arguments", "a duration must be above 0", expression=span)
    return out


def unit(x: str) -> str:
    u = (literal(x) or x).lower().rstrip("s")
    if u not in UNITS:
        raise QueryError("arguments", "no unit of time", expression=x)
    return u


for _name, _f in (("year", "year"), ("month", "month"), ("day_of_month", "dayofmonth"), ("day_of_year", "dayofyear"), ("hour", "hour"), ("minute", "minute"), ("second", "second")):
    function(_name)(lambda s, x, f=_f: f"{f}({time(s, x)})")
function("day_of_week")(lambda s, x: f"(weekday({time(s, x)}) + 1)")
function("now", least=0, most=1)(lambda s, f=None: "unix_millis(current_timestamp())" if f is None else f"date_format(current_timestamp(), {f})")
function("current_timestamp", least=0)(lambda s: "current_timestamp()")
function("current_date", least=0)(lambda s: "current_date()")
function("current_time", least=0)(lambda s: "date_format(current_timestamp(), 'HH:mm:ss')")


@function("date_format", "format_datetime", "dateformat", least=2, most=3)
def _format(scope, x: str, fmt: str, zone: str | None = None) -> str:
    t = time(scope, x)
    return f"date_format({t if zone is None else f'from_utc_timestamp({t}, {zone})'}, {fmt})"


function("date_add", least=3)(lambda s, t, n, u: f"timestampadd({unit(u)}, cast({number(s, n)} as int), {time(s, t)})")
function("date_sub", least=3)(lambda s, t, n, u: f"timestampadd({unit(u)}, -cast({number(s, n)} as int), {time(s, t)})")
function("date_diff", least=2, most=3)(lambda s, a, b, u="'day'": f"timestampdiff({unit(u)}, {time(s, b)}, {time(s, a)})")
function("datediff", least=2)(lambda s, a, b: f"timestampdiff(day, {time(s, b)}, {time(s, a)})")
function("date_trunc", least=2)(lambda s, u, t: f"date_trunc('{unit(u)}', {time(s, t)})")


@function("time_bucket", least=2)
def _bucket(scope, span: str, t: str) -> str:
    b = millis(literal(span) or span)
    return f"timestamp_millis(unix_millis({time(scope, t)}) - pmod(unix_millis({time(scope, t)}), {b}L))"


#: Parts of a time as expressions; fixed names of the dialect.
PARTS = {
    "year": "year({t})", "quarter": "quarter({t})", "month": "month({t})", "week": "weekofyear({t})", "day": "day({t})", "hour": "hour({t})", "minute": "minute({t})",
    "second": "second({t})", "dow": "(weekday({t}) + 1)", "doy": "dayofyear({t})", "millisecond": "(unix_millis({t}) % 1000)", "microsecond": "(unix_micros({t}) % 1000000)",
    "epoch": "unix_seconds({t})",
}


@function("date_part", "extract", least=2)
def _part(scope, part: str, t: str) -> str:
    p = (literal(part) or part).lower()
    p = {"dayofweek": "dow", "isodow": "dow", "dayofyear": "doy", "milliseconds": "millisecond", "microseconds": "microsecond"}.get(p, p)
    if p not in PARTS:
        raise QueryError("arguments", "no part of a time", expression=part)
    return f"cast({PARTS[p].format(t=time(scope, t))} as bigint)"


function("unix_timestamp", least=0, most=1)(lambda s, t=None: "unix_seconds(current_timestamp())" if t is None else f"unix_seconds({time(s, t)})")
function("to_unixtime")(lambda s, t: f"(unix_millis({time(s, t)}) / 1000D)")
function("to_millis", "epoch_ms")(lambda s, t: f"unix_millis({time(s, t)})")


@function("from_unixtime", least=1, most=2)
def _from(scope, x: str, fmt: str | None = None) -> str:
    t = f"timestamp_seconds({number(scope, x) if numeric(scope.type(x)) else f'try_cast({x} as double)'})"
    return t if fmt is None else f"date_format({t}, {fmt})"


@function("to_iso_instant")
def _iso(scope, t: str) -> str:
    u = f"to_utc_timestamp({time(scope, t)}, current_timezone())"
    return f"date_format({u}, if(unix_millis({u}) % 1000 = 0, \"yyyy-MM-dd'T'HH:mm:ss'Z'\", \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"))"
