"""The function registry, and the dialect's coercions and comparisons as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..errors import QueryError

Builder = Callable[..., str]
FUNCTIONS: dict[str, tuple[int, int, Builder]] = {}
UDFS: dict[str, Callable] = {}
MANY = 1 << 30


def function(*names: str, least: int = 1, most: int | None = None) -> Callable[[Builder], Builder]:
    """Register builder(scope, *args) under names; args are SQL texts."""

    def add(build: Builder) -> Builder:
        for n in names:
            FUNCTIONS[n.lower()] = (least, least if most is None else most, build)
        return build

    return add


def call(scope, name: str, args: list[str]) -> str:
    if name.lower() not in FUNCTIONS:
        raise QueryError("unsupported", "unknown function", expression=name)
    least, most, build = FUNCTIONS[name.lower()]
    if not least <= len(args) <= most:
        raise QueryError("arguments", f"{name} takes {least} to {most} arguments, not {len(args)}", expression=name)
    return build(scope, *args)


def register_udfs(spark: SparkSession) -> None:
    for name, f in UDFS.items():
        spark.udf.register(name, f)


# --- types ---------------------------------------------------------------------------------------


def integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def temporal(t: T.DataType) -> bool:
    return isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType)


def number(scope, x: str) -> str:
    """A number: numbers stay, strings go by double, times become epoch milliseconds."""
    t = scope.type(x)
    if numeric(t):
        return x
    if temporal(t):
        return f"unix_millis(cast({x} as timestamp))"
    return f"cast({x} as int)" if isinstance(t, T.BooleanType) else f"try_cast({x} as double)"


def double(scope, x: str) -> str:
    return f"cast({number(scope, x)} as double)"


def long(scope, x: str) -> str:
    return f"cast({number(scope, x)} as bigint)"


def text(scope, x: str) -> str:
    return x if isinstance(scope.type(x), T.StringType) else f"cast({x} as string)"


def time(scope, x: str) -> str:
    """A timestamp: numbers and digit strings are epoch milliseconds."""
    t = scope.type(x)
    if isinstance(t, T.TimestampType):
        return x
    if temporal(t):
        return f"cast({x} as timestamp)"
    if numeric(t):
        return f"timestamp_millis(cast({x} as bigint))"
    return f"coalesce(timestamp_millis(try_cast({x} as bigint)), try_cast({x} as timestamp))"


def literal(x: str) -> str | None:
    """The value of a string literal's SQL text, else None."""
    return x[1:-1].replace("\\'", "'").replace("\\\\", "\\") if len(x) > 1 and x[0] == x[-1] == "'" else None


def quote(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def truth(scope, x: str) -> str:
    """Truthiness: true, y, ok, yes, 1, on; or a number whose whole part is 1. Null stays null."""
    t = scope.type(x)
    if isinstance(t, T.BooleanType):
        return x
    if numeric(t):
        return f"(cast({x} as bigint) = 1)"
    return f"(lower(cast({x} as string)) in ('true', 'y', 'ok', 'yes', '1', 'on'))"


def aligned(scope, a: str, b: str) -> tuple[str, str]:
    """Two operands in a common type: times before numbers before strings; what can't be cast is null."""
    x, y = scope.type(a), scope.type(b)
    if type(x) is type(y):
        return a, b
    if temporal(x) or temporal(y):
        return time(scope, a), time(scope, b)
    if numeric(x) or numeric(y):
        return (a, b) if numeric(x) and numeric(y) else (double(scope, a), double(scope, b))
    if isinstance(x, T.BooleanType) or isinstance(y, T.BooleanType):
        return truth(scope, a), truth(scope, b)
    return a, b


def compare(scope, op: str, a: str, b: str) -> str:
    """A comparison without a third truth value: null, or what can't be compared, is false."""
    x, y = aligned(scope, a, b)
    return f"coalesce({x} {op} {y}, false)"


def collection(scope, x: str) -> str:
    """An array: arrays stay, anything else becomes one element, null none."""
    if isinstance(scope.type(x), T.ArrayType):
        return f"coalesce({x}, array())"
    return f"array_compact(array({x}))"


def mixed(scope, args: tuple[str, ...] | list[str]) -> list[str]:
    """Values for one list or map: as they are if their types agree, else as texts."""
    kinds = [scope.type(a) for a in args]
    known = [k for k in kinds if not isinstance(k, T.NullType)]
    same = len({type(k) for k in known}) <= 1 or all(map(numeric, known))
    return list(args) if same else [a if isinstance(k, T.NullType) else text(scope, a) for a, k in zip(args, kinds)]


def flat(scope, args: tuple[str, ...]) -> str:
    """All arguments as one array without nulls; elements of different types become texts."""
    parts = [collection(scope, a) for a in args]
    kinds = [scope.type(p).elementType for p in parts]
    known = [k for k in kinds if not isinstance(k, T.NullType)]
    if len({type(k) for k in known}) > 1 and not all(map(numeric, known)):
        parts = [f"transform({p}, x -> cast(x as string))" for p in parts]
    return f"array_compact({parts[0] if len(parts) == 1 else f'concat({", ".join(parts)})'})"


def alike(scope, a: str, b: str) -> tuple[str, str]:
    """Two arrays whose elements compare as ``compare`` does: numbers with texts as numbers, times with others as times."""
    x, y = scope.type(a).elementType, scope.type(b).elementType
    if type(x) is type(y) or numeric(x) and numeric(y) or isinstance(x, T.NullType) or isinstance(y, T.NullType):
        return a, b
    if temporal(x) or temporal(y):
        to = lambda t: "cast(v as timestamp)" if temporal(t) else "timestamp_millis(cast(v as bigint))" if numeric(t) else "coalesce(timestamp_millis(try_cast(v as bigint)), try_cast(v as timestamp))"
    elif numeric(x) or numeric(y):
        to = lambda t: "cast(cast(v as int) as double)" if isinstance(t, T.BooleanType) else "try_cast(v as double)"
    else:
        to = lambda t: "cast(v as string)"
    return tuple(f"array_compact(transform({e}, v -> {to(t)}))" for e, t in ((a, x), (b, y)))
