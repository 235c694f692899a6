"""Strings and regular expressions."""

from __future__ import annotations

import re

from ..errors import QueryError
from .core import MANY, flat, function, literal, number, quote, text

#: Limits of lengths in characters; settings of the same meaning replace them.
MAX_PATTERN, MAX_INPUT, MAX_REPLACEMENT, MAX_OUTPUT = 1024, 256 * 1024, 64 * 1024, 1_000_000
_NESTED = re.compile(r"\([^()]*[+*][^()]*\)[+*{]")


def _n(scope, x: str) -> str:
    return f"cast({number(scope, x)} as int)"


def made(scope, size: str, x: str, what: str) -> str:
    """x, unless it would be longer than the limit of generated texts."""
    most = int(scope.setting("function.maxGeneratedStringLength", MAX_OUTPUT))
    return f"if({size} > {most}, raise_error('resource_limit: {what} makes over {most} characters'), {x})"


for _name in ("lower", "upper", "reverse", "trim"):
    function(_name)(lambda s, x, f=_name: f"{f}({text(s, x)})")
function("length", "char_length")(lambda s, x: f"cast(length({text(s, x)}) as bigint)")
function("ltrim")(lambda s, x: f"regexp_replace({text(s, x)}, '^\\\\s+', '')")
function("rtrim")(lambda s, x: f"regexp_replace({text(s, x)}, '\\\\s+$', '')")


@function("replace", least=3)
def _replace(scope, x: str, a: str, b: str) -> str:
    x, a, b = text(scope, x), text(scope, a), text(scope, b)
    return made(scope, f"(if({a} = '', 0L, cast(length({x}) as bigint) div greatest(length({a}), 1) * greatest(length({b}) - length({a}), 0)) + length({x}))", f"replace({x}, {a}, {b})", "replace")




def _cut(scope, x: str, start: str, size: str | None, base: int) -> str:
    """From start (counted from base, or from the end if negative); out of range is empty."""
    x, k = text(scope, x), _n(scope, start)
    first = f"if({k} < 0, length({x}) + {k} + 1, {k} + {1 - base})"
    rest = f"substring({x}, {first}" + (f", greatest({_n(scope, size)}, 0))" if size is not None else ")")
    return f"case when {x} is null then null when {first} < 1 or {first} > length({x}) then '' else {rest} end"


function("substring", least=2, most=3)(lambda s, x, k, n=None: _cut(s, x, k, n, 1))
function("substr", least=2, most=3)(lambda s, x, k, n=None: _cut(s, x, k, n, 0))
function("left", "str_left", least=2)(lambda s, x, n: f"left({text(s, x)}, greatest({_n(s, n)}, 0))")
function("right", "str_right", least=2)(lambda s, x, n: f"right({text(s, x)}, greatest({_n(s, n)}, 0))")


@function("split_part", least=3)
def _split_part(scope, x: str, d: str, i: str) -> str:
    x, i = text(scope, x), _n(scope, i)
    return f"case when {i} = 0 then '' when {d} = '' then if(abs({i}) = 1, {x}, '') else split_part({x}, {d}, if({i} = 0, 1, {i})) end"


function("starts_with", least=2)(lambda s, x, y: f"startswith({text(s, x)}, {text(s, y)})")
function("ends_with", least=2)(lambda s, x, y: f"endswith({text(s, x)}, {text(s, y)})")
function("str_contains", "contains", least=2)(lambda s, x, y: f"contains({text(s, x)}, {text(s, y)})")
function("strpos", "position", "instr", least=2)(lambda s, x, y: f"cast(instr({text(s, x)}, {text(s, y)}) as bigint)")
function("locate", least=2, most=3)(lambda s, y, x, k="1": f"cast(locate({text(s, y)}, {text(s, x)}, {_n(s, k)}) as bigint)")
function("concat", most=MANY)(lambda s, *a: f"array_join(transform({flat(s, tuple(_texts(s, a)))}, x -> cast(x as string)), '')")


@function("concat_ws", least=2, most=MANY)
def _concat_ws(scope, sep: str, *args: str) -> str:
    parts, sep = flat(scope, tuple(_texts(scope, args))), text(scope, sep)
    size = f"aggregate({parts}, 0L, (n, x) -> n + length(x) + length({sep}))"
    return made(scope, size, f"array_join({parts}, {sep})", "concat_ws")




def _texts(scope, args: tuple[str, ...]):
    from pyspark.sql import types as T

    return (f"transform({a}, x -> cast(x as string))" if isinstance(scope.type(a), T.ArrayType) else text(scope, a) for a in args)


def _pad(f: str):
    def build(scope, x: str, n: str, pad: str = "' '") -> str:
        x, n = text(scope, x), _n(scope, n)
        return made(scope, n, f"case when {n} <= 0 then '' when {pad} = '' and length({x}) < {n} then null else {f}({x}, {n}, {pad}) end", f)

    return build


function("lpad", least=2, most=3)(_pad("lpad"))
function("rpad", least=2, most=3)(_pad("rpad"))


@function("repeat", least=2)
def _repeat(scope, x: str, n: str) -> str:
    x, n = text(scope, x), _n(scope, n)
    return made(scope, f"cast(length({x}) as bigint) * greatest({n}, 0)", f"repeat({x}, {n})", "repeat")


def subject(scope, x: str) -> str:
    """A text that a pattern is matched against, of bounded length."""
    most, x = int(scope.setting("function.regex.maxInputLength", MAX_INPUT)), text(scope, x)
    return f"if(length({x}) > {most}, raise_error('resource_limit: over {most} characters for a pattern'), {x})"


def pattern(scope, p: str, flags: str | None = None) -> str:
    value = literal(p)
    if value is not None:
        if len(value) > int(scope.setting("function.regex.maxPatternLength", MAX_PATTERN)):
            raise QueryError("resource_limit", "the pattern is too long", expression=p)
        if _NESTED.search(value):
            raise QueryError("unsupported", "nested quantifiers aren't safe", expression=p)
        try:
            re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", value))
        except re.error as e:
            raise QueryError("arguments", f"no regular expression: {e}", expression=p) from None
    return f"concat('(?i)', {p})" if flags and "i" in (literal(flags) or "") else p




@function("regexp_replace", least=3, most=4)
def _regexp_replace(scope, x: str, p: str, r: str, flags: str | None = None) -> str:
    most = int(scope.setting("function.regex.maxReplacementLength", MAX_REPLACEMENT))
    if literal(r) is not None and len(literal(r)) > most:
        raise QueryError("resource_limit", "the replacement is too long", expression=r)
    out = f"regexp_replace({subject(scope, x)}, {pattern(scope, p, flags)}, {r})"
    return made(scope, f"length({out})", out, "regexp_replace")


function("regexp_like", least=2, most=3)(lambda s, x, p, f=None: f"rlike({subject(s, x)}, {pattern(s, p, f)})")


@function("regexp_extract", "regexp_substr", least=2, most=3)
def _extract(scope, x: str, p: str, group: str | None = None) -> str:
    """By default group 1 if the pattern has one, else all; no match, or no such group, is null."""
    x, value = subject(scope, x), literal(p)
    pattern(scope, p)
    groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", value)).groups if value is not None else 0
    k = int(number(scope, group)) if group is not None else min(groups, 1)
    if value is not None and not 0 <= k <= groups:
        return "cast(null as string)"
    return f"if(rlike({x}, {p}), regexp_extract({x}, {p}, {k}), null)"


def like(scope, x: str, p: str) -> str:
    """% stands for any characters; _ is an ordinary character; the rest is a regular expression over the whole string."""
    x, value = text(scope, x), literal(p)
    if value is None:
        return f"coalesce(rlike({x}, concat('^(?:', replace({text(scope, p)}, '%', '.*'), ')$')), false)"
    if not re.search(r"[!\\.\[\](){}^$*+?|]", value):
        return f"coalesce({x} like {quote(value.replace('_', '!_'))} escape '!', false)"
    return f"coalesce(rlike({x}, {quote('^(?:' + value.replace('%', '.*') + ')$')}), false)"


function("str_like", least=2)(like)
function("str_nlike", least=2)(lambda s, x, p: f"({text(s, x)} is not null and not {like(s, x, p)})")
