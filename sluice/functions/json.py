"""JSON over text, maps, structs and arrays. Built-in functions where they have the semantics, else vectorised UDFs."""

from __future__ import annotations

import json as js

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .core import MANY, UDFS, function, literal, quote, text

MAX_PATH = 1024
#: Limits of a document and of what is made of it; hints of these names replace them.
MAX_TEXT, MAX_DEPTH, MAX_ITEMS = 2 * 1024 * 1024, 128, 100_000


def quoted(x: str) -> str:
    """A text as a JSON string: every character that JSON escapes is escaped."""
    return f"if({x} is null, null, substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2))"


def document(scope, x: str) -> str:
    """JSON text of a value; a string that isn't JSON is a JSON string."""
    t = scope.type(x)
    if isinstance(t, T.StringType):
        most = int(scope.setting("json.maxLength", MAX_TEXT))
        small = x if literal(x) is not None else f"if(octet_length({x}) > {most}, raise_error('resource_limit: a JSON text of over {most} bytes'), {x})"
        return f"coalesce(if(try_parse_json({small}) is null, null, {x}), {quoted(x)})"
    if isinstance(t, T.MapType | T.StructType | T.ArrayType):
        return f"to_json({x})"
    return f"cast({x} as string)"


def path(p: str) -> str:
    """A checked, literal path; only simple ones are taken."""
    v = literal(p)
    if v is None:
        raise QueryError("unsupported", "this JSON path must be a literal", expression=p)
    if len(v) > MAX_PATH or ".." in v or any(c in v for c in "?(*"):
        raise QueryError("unsupported", "this JSON path isn't safe", expression=p, suggestion="name properties and positions, as in $.a.b[0]")
    return quote(v if v.startswith("$") else f"$.{v}")


def _get(scope, j: str, p: str, kind: str = "string") -> str:
    if literal(p) is None:  # a path that each row brings along is checked when it is read
        checked = f"if(length({p}) > {MAX_PATH} or rlike({p}, '[?(*]|[.][.]'), raise_error('unsupported: this JSON path is not safe'), if(startswith({p}, '$'), {p}, concat('$.', {p})))"
        return f"get_json_object({document(scope, j)}, {checked})"
    return f"try_variant_get(try_parse_json({document(scope, j)}), {path(p)}, '{kind}')"


def _or(x: str, default: str | None) -> str:
    return x if default is None else f"coalesce({x}, cast({default} as string))"


function("json_get", "json_path", "json_value", least=2, most=3)(lambda s, j, p, d=None: _or(_get(s, j, p), d))
function("json_query", least=2)(lambda s, j, p: _get(s, j, p))
function("json_extract", least=2, most=MANY)(lambda s, j, *p: _get(s, j, p[0]) if len(p) == 1 else f"array({', '.join(_get(s, j, x) for x in p)})")
function("json_exists", least=1, most=2)(lambda s, j, p="'$'": f"({_get(s, j, p, 'variant')} is not null)")


def steps(*segments: str) -> str:
    out = "$"
    for seg in segments:
        v = literal(seg) if literal(seg) is not None else seg
        out += f"[{v}]" if v.lstrip("-").isdecimal() else v[1:] if v.startswith("$.") else f"['{v}']" if not v.isidentifier() else f".{v}"
    return quote(out)


for _names in (("json_extract_path", "jsonb_extract_path"), ("json_extract_path_text", "jsonb_extract_path_text")):
    function(*_names, least=2, most=MANY)(lambda s, j, *p: _get(s, j, steps(*p)))


@function("json_contains_path", least=3, most=MANY)
def _contains_path(scope, j: str, mode: str, *paths: str) -> str:
    word = {"one": " or ", "all": " and "}.get((literal(mode) or "").lower())
    if word is None:
        raise QueryError("arguments", "the mode is 'one' or 'all'", expression=mode)
    return "(" + word.join(f"{_get(scope, j, p, 'variant')} is not null" for p in paths) + ")"


function("json_valid")(lambda s, x: f"(try_parse_json({text(s, x)}) is not null)")
function("json_unquote")(lambda s, x: f"try_variant_get(try_parse_json({document(s, x)}), '$', 'string')")
function("json_quote")(lambda s, x: quoted(text(s, x)))
function("json_array_length", "jsonb_array_length")(lambda s, x: f"cast(json_array_length({document(s, x)}) as bigint)")
function("json_keys", "json_object_keys", "jsonb_object_keys", least=1, most=2)(lambda s, x, p="'$'": f"json_object_keys({_get(s, x, p)})")


@function("json_length", least=1, most=2)
def _length(scope, x: str, p: str = "'$'") -> str:
    v = _get(scope, x, p)
    return f"cast(case when {v} is null then null else coalesce(json_array_length({v}), size(json_object_keys({v})), 1) end as bigint)"


def _type(scope, x: str) -> str:
    return f"schema_of_variant(try_parse_json({document(scope, x)}))"


@function("json_type")
def _json_type(scope, x: str) -> str:
    t = _type(scope, x)
    return f"case when {t} like 'OBJECT%' then 'OBJECT' when {t} like 'ARRAY%' then 'ARRAY' when {t} = 'STRING' then 'STRING' when {t} = 'BIGINT' then 'INTEGER' when {t} = 'BOOLEAN' then 'BOOLEAN' when {t} = 'VOID' then 'NULL' when {t} is not null then 'DOUBLE' end"


@function("json_typeof", "jsonb_typeof")
def _typeof(scope, x: str) -> str:
    t = _json_type(scope, x)
    return f"replace(replace(lower({t}), 'integer', 'number'), 'double', 'number')"


function("to_json")(lambda s, x: document(s, x))
function("json_array", "json_build_array", "jsonb_build_array", least=0, most=MANY)(lambda s, *a: f"concat('[', array_join(array({', '.join(_value(s, x) for x in a)}), ','), ']')" if a else "'[]'")
function("json_object", "json_build_object", "jsonb_build_object", least=0, most=MANY)(
    lambda s, *a: "concat('{', array_join(array(" + ", ".join(f"concat({quoted(text(s, k))}, ':', {_value(s, v)})" for k, v in zip(a[::2], a[1::2])) + "), ','), '}')" if len(a) > 1 else "'{}'"
)


def _value(scope, x: str) -> str:
    t = scope.type(x)
    return f"coalesce({quoted(x) if isinstance(t, T.StringType) else document(scope, x)}, 'null')"


# --- what no built-in does: values are compared deeply, numbers by value ---------------------------


def _same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return type(a) is type(b) and a == b or isinstance(a, int | float) and isinstance(b, int | float) and a == b


def _inside(whole, part) -> bool:
    if isinstance(whole, dict) and isinstance(part, dict):
        return all(k in whole and _inside(whole[k], v) for k, v in part.items())
    if isinstance(whole, list):
        return all(any(_inside(w, p) for w in whole) for p in part) if isinstance(part, list) else any(_inside(w, part) for w in whole)
    return _same(whole, part)


def _overlap(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return any(k in b and _same(v, b[k]) for k, v in a.items())
    xs, ys = (x if isinstance(x, list) else [x] for x in (a, b))
    return any(_same(x, y) for x in xs for y in ys)


def _has(items: list, x) -> bool:
    return any(_same(x, y) for y in items)


def _intersection(a, b):
    if isinstance(a, dict):
        return {k: v for k, v in a.items() if k in b and _same(v, b[k])}
    out: list = []
    return [out.append(x) or x for x in a if _has(b, x) and not _has(out, x)]


def _union(a, b):
    if isinstance(a, dict):
        return a | b
    out: list = []
    return [out.append(x) or x for x in [*a, *b] if not _has(out, x)]


def _difference(a, b):
    return {k: v for k, v in a.items() if k not in b} if isinstance(a, dict) else [x for x in a if not _has(b, x)]


def _preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _preserve(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def _patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


def _depth(x) -> int:
    return 1 + max(map(_depth, x.values() if isinstance(x, dict) else x), default=0) if isinstance(x, dict | list) else 1


def _binary(name: str, kind: str, f) -> None:
    @F.pandas_udf(T.StringType() if kind == "string" else T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            try:
                left, right = js.loads(x), js.loads(y)
            except ValueError:
                return None
            for value in (left, right):
                if _depth(value) > MAX_DEPTH or isinstance(value, dict | list) and len(value) > MAX_ITEMS:
                    raise ValueError(f"resource_limit: JSON deeper than {MAX_DEPTH} or longer than {MAX_ITEMS}")
            try:
                out = f(left, right)
            except (TypeError, AttributeError):
                return None
            return js.dumps(out, separators=(",", ":"), ensure_ascii=False) if kind == "string" else out

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    UDFS[name] = run


for _name, _kind, _f in (
    ("sluice_json_contains", "boolean", _inside), ("sluice_json_overlaps", "boolean", _overlap), ("sluice_json_equal", "boolean", _same), ("sluice_json_intersect", "string", _intersection),
    ("sluice_json_union", "string", _union), ("sluice_json_diff", "string", _difference), ("sluice_json_merge", "string", _preserve), ("sluice_json_patch", "string", _patch),
):
    _binary(_name, _kind, _f)


@F.pandas_udf(T.LongType())
def _depths(a: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else _depth(js.loads(x))
        except ValueError:
            return None

    return pd.Series([one(x) for x in a], dtype="Int64")


UDFS["sluice_json_depth"] = _depths
function("json_depth")(lambda s, x: f"sluice_json_depth({document(s, x)})")
for _names, _udf in (
    (("json_overlaps",), "overlaps"), (("json_equal", "json_equals"), "equal"), (("json_intersect", "json_intersection"), "intersect"), (("json_union",), "union"),
    (("json_diff", "json_except"), "diff"), (("json_merge", "json_merge_preserve"), "merge"), (("json_merge_patch",), "patch"),
):
    function(*_names, least=2)(lambda s, a, b, f=_udf: f"sluice_json_{f}({document(s, a)}, {document(s, b)})")
function("json_contains", least=2, most=3)(lambda s, a, b, p=None: f"sluice_json_contains({document(s, a) if p is None else _get(s, a, p)}, {document(s, b)})")
