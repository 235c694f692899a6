"""Arithmetic, bits, comparisons and mathematics."""

from __future__ import annotations

from .core import MANY, alike, compare, double, flat, function, integral, long, mixed, number, numeric, truth


def arithmetic(scope, op: str, a: str, b: str) -> str:
    """Whole numbers stay whole: they divide truncating, and are taken as 64 bits."""
    x, y = number(scope, a), number(scope, b)
    if integral(scope.type(x)) and integral(scope.type(y)):
        x, y = f"cast({x} as bigint)", f"cast({y} as bigint)"
        return f"({x} div {y})" if op == "/" else f"({x} {op} {y})"
    if op == "/":
        x, y = f"cast({x} as double)", f"cast({y} as double)"
        return f"if({y} = 0D, if({x} = 0D, double('NaN'), {x} * double('Infinity')), try_divide({x}, {y}))"
    return f"({x} {op} {y})"


for _names, _op in ((("math.plus",), "+"), (("math.sub",), "-"), (("math.mul",), "*"), (("math.divi",), "/"), (("math.mod",), "%")):
    function(*_names, least=2)(lambda s, a, b, op=_op: arithmetic(s, op, a, b))
for _name, _op in (("bit_and", "&"), ("bit_or", "|"), ("bit_mutex", "^")):
    function(_name, least=2)(lambda s, a, b, op=_op: f"({long(s, a)} {op} {long(s, b)})")
for _name, _f in (("bit_left_shift", "shiftleft"), ("bit_right_shift", "shiftright"), ("bit_unsigned_shift", "shiftrightunsigned")):
    function(_name, least=2)(lambda s, a, b, f=_f: f"{f}({long(s, a)}, cast({number(s, b)} as int))")
function("bit_not")(lambda s, a: f"(~{long(s, a)})")
function("bit_count")(lambda s, a: f"cast(bit_count({long(s, a)}) as bigint)")
for _name, _op in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    function(_name, least=2)(lambda s, a, b, op=_op: compare(s, op, a, b))

for _name in ("sqrt", "sin", "asin", "sinh", "cos", "cosh", "acos", "tan", "tanh", "atan", "log1p", "log10", "exp", "expm1", "rint", "degrees", "radians"):
    function(f"math.{_name}", *([_name] if _name == "sqrt" else []))(lambda s, x, f=_name: f"{f}({double(s, x)})")
function("math.log")(lambda s, x: f"ln({double(s, x)})")
for _name in ("floor", "ceil", "abs"):
    function(_name, f"math.{_name}")(lambda s, x, f=_name: f"cast({f}({double(s, x)}) as double)")
function("pow", "power", least=2)(lambda s, x, y: f"pow({double(s, x)}, {double(s, y)})")
function("math.atan2", least=2)(lambda s, y, x: f"atan2({double(s, y)}, {double(s, x)})")
function("math.ieee_rem", least=2)(lambda s, x, y: f"({double(s, x)} - {double(s, y)} * rint({double(s, x)} / {double(s, y)}))")
function("math.copy_sign", least=2)(lambda s, x, y: f"if({double(s, y)} < 0 or cast({double(s, y)} as string) = '-0.0', -abs({double(s, x)}), abs({double(s, x)}))")
function("math.round")(lambda s, x: f"cast(floor({double(s, x)} + 0.5D) as bigint)")


@function("round", least=1, most=2)
def _round(scope, x: str, digits: str | None = None) -> str:
    """Ties go up; one argument gives a whole number."""
    x = double(scope, x)
    if digits is None:
        return f"cast(floor({x} + 0.5D) as bigint)"
    return f"(floor({x} * pow(10D, {digits}) + 0.5D) / pow(10D, {digits}))"


def _all_double(scope, args: tuple[str, ...]) -> str:
    return f"transform({flat(scope, args)}, x -> cast(x as double))"


function("math.max", most=MANY)(lambda s, *a: f"array_max({_all_double(s, a)})")
function("math.min", most=MANY)(lambda s, *a: f"array_min({_all_double(s, a)})")
function("math.avg", most=MANY)(lambda s, *a: f"aggregate({_all_double(s, a)}, 0D, (t, x) -> t + x, t -> t / nullif(size({flat(s, a)}), 0))")
function("math.count", most=MANY)(lambda s, *a: "cast(" + " + ".join(f"if({x} is null, 0, 1)" for x in a) + " as bigint)")
function("greatest", most=MANY)(lambda s, *a: f"array_max({flat(s, a)})")
function("least", most=MANY)(lambda s, *a: f"array_min({flat(s, a)})")
function("all_match", most=MANY)(lambda s, *a: "(" + " and ".join(f"coalesce({truth(s, x)}, false)" for x in a) + ")")
function("any_match", most=MANY)(lambda s, *a: "(" + " or ".join(f"coalesce({truth(s, x)}, false)" for x in a) + ")")
function("coalesce", most=MANY)(lambda s, *a: f"coalesce({', '.join(a)})")
function("if", least=2, most=3)(lambda s, c, a, b="null": f"if(coalesce({truth(s, c)}, false), {a}, {b})")
function("choose", least=2, most=MANY)(lambda s, i, *v: f"get(array({', '.join(mixed(s, v))}), cast({number(s, i)} as int) - 1)")
function("isnull", most=MANY)(lambda s, *a: "(" + " and ".join(f"{x} is null" for x in a) + ")")
function("notnull", most=MANY)(lambda s, *a: "(" + " or ".join(f"{x} is not null" for x in a) + ")")


def _among(scope, x: str, items: tuple[str, ...]) -> str:
    have, want = alike(scope, flat(scope, items), f"array({x})")
    return f"coalesce(array_contains({have}, get({want}, 0)), false)"


function("in", least=2, most=MANY)(lambda s, x, *a: _among(s, x, a))
function("nin", least=2, most=MANY)(lambda s, x, *a: f"not {_among(s, x, a)}")


def between(scope, x: str, lo: str, hi: str) -> str:
    """Inclusive. Numbers as they stand; of strings and times x must be the middle one, so bounds may be reversed."""
    if numeric(scope.type(x)):
        return f"({compare(scope, '>=', x, lo)} and {compare(scope, '<=', x, hi)})"
    a, lo = (p for p in (x, lo))
    return f"(({compare(scope, '>=', a, lo)} and {compare(scope, '<=', a, hi)}) or ({compare(scope, '>=', a, hi)} and {compare(scope, '<=', a, lo)}))"


@function("btw", "range", least=2, most=3)
def _btw(scope, x: str, lo: str, hi: str | None = None) -> str:
    if hi is None:
        lo, hi = f"get({lo}, 0)", f"element_at({lo}, -1)"
    return between(scope, x, lo, hi)


function("nbtw", least=2, most=3)(lambda s, *a: f"not {_btw(s, *a)}")

#: Names of cast targets; fixed values of the dialect.
CASTS = {
    "string": "string", "varchar": "string", "char": "string", "text": "string", "number": "double", "decimal": "decimal(38,10)", "numeric": "decimal(38,10)",
    "bigdecimal": "decimal(38,10)", "int": "int", "integer": "int", "signed": "int", "long": "bigint", "bigint": "bigint", "double": "double", "float8": "double",
    "bool": "boolean", "boolean": "boolean", "byte": "tinyint", "tinyint": "tinyint", "short": "smallint", "smallint": "smallint", "float": "float", "real": "float",
    "float4": "float", "double precision": "double", "character varying": "string", "date": "timestamp", "datetime": "timestamp", "timestamp": "timestamp",
}


def cast(scope, x: str, kind: str) -> str:
    """Strings become whole numbers by way of double; an unknown type leaves the value as it is."""
    from .core import text, time

    to = CASTS.get(kind.lower())
    if to is None:
        return x
    if to == "string":
        return text(scope, x)
    if to == "boolean":
        return f"coalesce({truth(scope, x)}, false)" if x != "null" else "cast(null as boolean)"
    if to == "timestamp":
        return time(scope, x)
    return f"try_cast({number(scope, x)} as {to})"
