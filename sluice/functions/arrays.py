"""Arrays and maps."""

from __future__ import annotations

from .core import MANY, alike, collection, flat, function, mixed

function("new_array", "array", "array_value", "list_value", "list_pack", least=0, most=MANY)(lambda s, *a: f"array_compact(array({', '.join(mixed(s, a))}))")


@function("new_map", least=0, most=MANY)
def _new_map(scope, *args: str) -> str:
    keys, values = mixed(scope, args[: len(args) // 2 * 2 : 2]), mixed(scope, args[1::2])
    return f"map({', '.join(x for pair in zip(keys, values) for x in pair)})"


function("array_len", most=MANY)(lambda s, *a: f"cast(size({flat(s, a)}) as bigint)")


@function("contains_all", least=2, most=MANY)
def _contains_all(scope, a: str, *b: str) -> str:
    """Whether each of the values stands in the list; a number equals its text."""
    have, want = alike(scope, flat(scope, (a,)), flat(scope, b))
    given = f"{b[0]} is not null" if len(b) == 1 else "true"
    return f"coalesce(forall({want}, w -> array_contains({have}, w)) and size({want}) = size({flat(scope, b)}) and {given}, false)"


def _overlap(scope, a: str, b: tuple[str, ...]) -> str:
    have, want = alike(scope, flat(scope, (a,)), flat(scope, b))
    return f"coalesce(arrays_overlap({have}, {want}), false)"


function("contains_any", least=2, most=MANY)(lambda s, a, *b: _overlap(s, a, b))
function("not_contains", least=2, most=MANY)(lambda s, a, *b: f"not {_overlap(s, a, b)}")


@function("row_to_array", "rows_to_array", most=MANY)
def _first_fields(scope, *rows: str) -> str:
    """The first value of each row, as a list."""
    from pyspark.sql import types as T

    arr = flat(scope, rows)
    kind = scope.type(arr).elementType
    if isinstance(kind, T.StructType):
        return f"array_compact(transform({arr}, x -> x.`{kind[0].name}`))"
    return f"array_compact(transform({arr}, x -> get(map_values(x), 0)))" if isinstance(kind, T.MapType) else arr


@function("array_to_row", least=3)
def _to_row(scope, rows: str, k: str, v: str) -> str:
    """A map from one field of each row to another; rows that lack either are skipped."""
    from pyspark.sql import types as T

    kind = scope.type(rows).elementType
    get = (lambda f: f"x[{f}]") if isinstance(kind, T.MapType) else (lambda f: f"x.`{f[1:-1]}`")
    return f"map_from_entries(filter(transform({rows}, x -> struct({get(k)} as key, {get(v)} as value)), e -> e.key is not null and e.value is not null))"
