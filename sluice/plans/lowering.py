"""From syntax trees to DataFrames: expressions become Spark SQL text, clauses become operators."""

from __future__ import annotations

import datetime
import decimal
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.core import FUNCTIONS, alike, call, compare, long, mixed, numeric, quote, temporal, text, truth
from ..functions.dates import millis
from ..functions.json import document, path, steps
from ..functions.numbers import arithmetic, between, cast
from ..functions.strings import like
from ..operators import aggregates as A
from ..operators import grouping as G
from ..operators import merging as M
from ..operators import rows as R
from .parser import Query, SetQuery, Source, With

AGGREGATES = {"count", "distinct_count", "sum", "avg", "max", "min", "take", "collect_list", "collect_row"}
EXPANSIONS = {"flat_array", "unnest", "explode", "each"}
BINARY = {"|": "bit_or", "&": "bit_and", "^": "bit_mutex", "<<": "bit_left_shift", ">>": "bit_right_shift", ">>>": "bit_unsigned_shift"}


@dataclass
class Bound:
    """A source in a query: its columns by name, and the internal names of its order of arrival and its time."""

    alias: str
    df: DataFrame
    columns: dict[str, str]
    order: list[str]
    time: str | None = None


@dataclass
class Result:
    df: DataFrame
    order: list[str] = field(default_factory=list)
    time: str | None = None


class Scope:
    def __init__(self, low: Lowering, bounds: list[Bound], outer: Scope | None = None) -> None:
        self.low, self.bounds, self.outer = low, bounds, outer
        self.aliases: dict[str, str] = {}
        self.fixed: dict[str, str] = {}
        self.aggs: list | None = None
        self.keys: dict[str, str] = {}
        self.used_outer = False
        self.extra: list[T.StructField] = []
        self.types: dict[str, T.DataType] = {}
        self.counts: set[str] = set()

    def setting(self, name: str, default):
        return self.low.settings.get(name, default)

    def fields(self) -> list[T.StructField]:
        own = [f for b in self.bounds for f in b.df.schema] + self.extra
        return own + (self.outer.fields() if self.outer else [])

    def type(self, sql: str) -> T.DataType:
        if sql not in self.types:
            names = {f.name: f for f in self.fields()}
            frame = self.low.spark.createDataFrame([], T.StructType(list(names.values())))
            self.types[sql] = frame.select(F.expr(sql)).schema[0].dataType
        return self.types[sql]

    def add(self, name: str, sql_type: T.DataType) -> None:
        self.extra.append(T.StructField(name, sql_type))

    # columns
    def find(self, parts: list[str]) -> str | None:
        if parts[0] in ("this", "$") and len(parts) > 1:
            return self.find(parts[1:])
        whole = ".".join(parts)
        if whole in ("this", "$"):
            first = self.bounds[0]
            return f"`{first.columns['this']}`" if "this" in first.columns else "struct(" + ", ".join(f"`{i}` as `{c}`" for c, i in first.columns.items()) + ")"
        if whole in self.fixed:
            return self.fixed[whole]
        for b in self.bounds:
            if b.alias == parts[0] and len(parts) > 1:
                for n in range(len(parts), 1, -1):
                    if (name := ".".join(parts[1:n])) in b.columns:
                        return self.step(f"`{b.columns[name]}`", parts[n:])
            if b.alias == whole:
                return f"`{b.columns['this']}`" if "this" in b.columns else "struct(" + ", ".join(f"`{i}` as `{c}`" for c, i in b.columns.items()) + ")"
        for n in range(len(parts), 0, -1):
            for b in self.bounds:
                if (name := ".".join(parts[:n])) in b.columns:
                    return self.step(f"`{b.columns[name]}`", parts[n:])
        if whole in self.aliases:
            return self.aliases[whole]
        if parts[0] in self.aliases:
            return self.step(self.aliases[parts[0]], parts[1:])
        if self.outer and (got := self.outer.find(parts)):
            self.used_outer = True
            return got
        return None

    def step(self, sql: str, rest: list[str]) -> str:
        for seg in rest:
            t, word = self.type(sql), seg.lstrip("$").lower()
            index = seg.strip("[]")
            own = next((x for p in self.low.engine.properties if (x := p(sql, t, seg)) is not None), None)
            if own is not None:
                sql = own
                continue
            if isinstance(t, T.ArrayType):
                if index.lstrip("-").isdecimal():
                    sql = f"get({sql}, {index})" if int(index) >= 0 else f"try_element_at({sql}, {index})"
                elif word in ("size", "empty"):
                    sql = f"cast(size({sql}) as bigint)" if word == "size" else f"(size({sql}) = 0)"
                else:
                    raise QueryError("unknown_name", "no property of a list", expression=seg)
            elif isinstance(t, T.MapType):
                if word in ("size", "empty", "keys", "values", "entries"):
                    sql = {"size": f"cast(size({sql}) as bigint)", "empty": f"(size({sql}) = 0)", "keys": f"map_keys({sql})", "values": f"map_values({sql})", "entries": f"map_entries({sql})"}[word]
                else:
                    sql = f"try_element_at({sql}, {quote(seg)})"
            elif isinstance(t, T.StructType):
                if seg not in t.names:
                    raise QueryError("unknown_name", "no such property", expression=seg)
                sql = f"{sql}.`{seg}`"
            else:
                sql = f"try_variant_get(try_parse_json({sql}), {quote('$' + (f'[{index}]' if index.isdecimal() else '.' + seg))}, 'string')"
        return sql

    # expressions
    def sql(self, e: tuple, bare: bool = False) -> str:
        """bare: null counts as false where the text stands, so comparisons need no guard and Catalyst sees plain joins."""
        return getattr(self, f"_{e[0]}")(*e[1:], **({"bare": bare} if e[0] in ("and", "compare", "in", "query", "exists") else {}))

    def condition(self, e: tuple, bare: bool = False) -> str:
        s = self.sql(e, bare)
        return s if e[0] in ("and", "or", "not", "compare", "is", "like", "between", "in", "exists") else truth(self, s)

    def _number(self, x: str) -> str:
        return f"{x}D" if "." in x else f"{x}L"

    def _string(self, x: str) -> str:
        return quote(x)

    def _word(self, x: str) -> str:
        return x

    def _typed(self, kind: str, x: str) -> str:
        return quote(x) if kind == "time" else f"{kind} {quote(x)}"

    def bound_value(self, name: str):
        params = self.low.params
        try:
            return params[int(name)] if isinstance(params, list | tuple) else params[int(name) if name.isdecimal() and int(name) in params else name]
        except (LookupError, ValueError):
            raise QueryError("arguments", "no value is bound", expression=name, suggestion="pass as many values as the text has marks") from None

    def _param(self, name: str) -> str:
        return self.value(self.bound_value(name))

    def value(self, v) -> str:
        """A Python value as SQL text."""
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return quote(v)
        if isinstance(v, float):
            return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"
        if isinstance(v, int):
            return f"{v}L" if abs(v) < 1 << 63 else f"cast('{v}' as decimal(38,0))"
        if isinstance(v, decimal.Decimal):
            return f"{v:f}BD"
        if isinstance(v, datetime.datetime):
            return f"timestamp '{v.isoformat(' ')}'"
        if isinstance(v, datetime.date):
            return f"date '{v.isoformat()}'"
        if isinstance(v, list | tuple | set | frozenset):
            return f"array({', '.join(mixed(self, [self.value(x) for x in v]))})"
        if isinstance(v, dict):
            keys, values = ([self.value(x) for x in part] for part in (v.keys(), v.values()))
            return f"map({', '.join(x for pair in zip(mixed(self, keys), mixed(self, values)) for x in pair)})"
        raise QueryError("arguments", "no SQL value", expression=type(v).__name__)

    def _column(self, parts: list[str]) -> str:
        whole = ".".join(parts)
        name, kind = parts, None
        if "::" in whole:
            whole, _, kind = whole.partition("::")
            name = whole.split(".")
        got = self.find(name)
        if got is None:
            raise QueryError("unknown_name", "no such column", expression=whole)
        if self.aggs is not None and got not in self.aliases.values():
            got = self.last(got)
        return cast(self, got, kind) if kind else got

    def last(self, sql: str) -> str:
        """In an aggregate query: the key if it is one, else the value in the group's last row."""
        if sql in self.keys:
            return f"`{self.keys[sql]}`"
        if sql in self.fixed.values() and not sql.startswith("`__row_"):
            return sql
        name = f"__l{len(self.aggs)}"
        kind = self.type(sql)
        self.aggs.append(A.Agg(name, F.max_by(F.expr(sql), F.struct(*[F.col(f"`{c}`") for c in self.low_order]))))
        self.add(name, kind)
        return f"`{name}`"

    def _at(self, e: tuple, index: tuple) -> str:
        k = index[1] if index[0] in ("number", "string") else None
        if k is None:
            return f"get({self.sql(e)}, cast({self.sql(index)} as int))"
        segs = [s for s in k.replace("[", ".[").split(".") if s] if index[0] == "string" else [f"[{k}]"]
        if e == ("column", ["this"]):
            return self.sql(("column", segs))
        return self.step(self.sql(e), segs)

    def _binary(self, op: str, a: tuple, b: tuple) -> str:
        x, y = self.sql(a), self.sql(b)
        if op == "||":
            return f"concat({text(self, x)}, {text(self, y)})"
        return call(self, BINARY[op], [x, y]) if op in BINARY else arithmetic(self, op, x, y)

    def _unary(self, op: str, e: tuple) -> str:
        x = self.sql(e)
        return x if op == "+" else f"(-{x})" if op == "-" else f"(~{long(self, x)})"

    def _cast(self, e: tuple, kind: str) -> str:
        return cast(self, self.sql(e), kind)

    def _json(self, op: str, e: tuple, key: tuple) -> str:
        x = self.sql(e)
        if op in ("#>", "#>>"):
            p = steps(*[quote(s.strip()) if not s.strip().lstrip("-").isdecimal() else s.strip() for s in key[1].strip("{}").split(",")])
        else:
            p = path(quote(key[1])) if key[0] == "string" and key[1].startswith("$") else steps(quote(key[1]) if key[0] == "string" else key[1])
        return f"try_variant_get(try_parse_json({document(self, x)}), {p}, 'string')"

    def _case(self, switch: tuple | None, whens: list, other: tuple | None) -> str:
        subject = self.sql(switch) if switch else None
        arms = []
        for c, v in whens:
            test = self.condition(c) if subject is None or c[0] in ("compare", "and", "or", "between", "in", "like", "is") else compare(self, "=", subject, self.sql(c))
            arms.append(f"when {test} then {self.sql(v)}")
        return f"case {' '.join(arms)}" + (f" else {self.sql(other)}" if other else "") + " end"

    def _call(self, name: str, args: list, modifier: str) -> str:
        if name in AGGREGATES or name in self.low.engine.aggregates:
            if self.aggs is None and self.in_text:
                return self.plain_aggregate(name, args, modifier)
            return self.aggregate(name, args, modifier)
        if name in self.low.engine.scalars:
            return self.low.engine.scalars[name](*[self.sql(a) for a in args])
        if name not in FUNCTIONS:
            raise QueryError("unsupported", "unknown function", expression=name)
        return call(self, name, [self.sql(a) for a in args])

    in_text = False

    def plain_aggregate(self, name: str, args: list, modifier: str) -> str:
        x = None if not args or args[0][0] in ("star", "number") else self.sql(args[0])
        if name == "count":
            return "count(1)" if x is None else f"count({modifier} {x})"
        if name in ("sum", "avg"):
            return f"{name}({modifier} cast({x} as double))"
        if name in ("max", "min"):
            return f"{name}({x})"
        raise QueryError("unsupported", "this aggregate can't stand in a correlated query", expression=name)

    def aggregate(self, name: str, args: list, modifier: str) -> str:
        if self.aggs is None:
            raise QueryError("unsupported", "an aggregate can't stand here", expression=name)
        held, self.aggs = self.aggs, None
        xs = [self.sql(a) for a in args if a[0] not in ("star", "query")]
        whole = [F.col(f"`{i}`").alias(c) for b in self.bounds for c, i in b.columns.items()]
        out = f"__a{len(held)}"
        order = [F.col(f"`{c}`") for c in self.low_order]
        value = F.expr(xs[0]) if xs else None
        d = F.expr(f"cast({xs[0]} as double)") if xs and name in ("sum", "avg") else value
        make = {"count": F.count, "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}.get(name)
        if name in ("count", "distinct_count"):
            self.counts.add(out)
        if name == "count" and (not xs or args[0][0] == "number"):
            agg = A.Agg(out, F.count(F.lit(1)))
        elif name == "distinct_count" or name == "count" and modifier == "distinct":
            agg = A.Agg(out, F.count_distinct(value))
        elif make and modifier == "unique":
            agg = A.unique(out, d, make, 0 if name == "count" else None)
        elif make:
            agg = A.Agg(out, F.sum_distinct(d) if name == "sum" and modifier else F.expr(f"avg(distinct cast({xs[0]} as double))") if name == "avg" and modifier else make(d))
        elif name == "take":
            counts = [int(self.constant(a)) for a in args[1:]] or [1]
            agg = A.taken(out, value, order, counts[0], counts[1] if len(counts) > 1 else None, modifier)
        elif name == "collect_list":
            if args and args[0][0] == "query":
                row = self.rows_of(args[0][1])
            else:
                names = [a[1][-1] if a[0] == "column" else a[1] for a in args if a[0] != "star"]
                row = F.struct(*[F.expr(x if a[0] == "column" else self.find([a[1]])).alias(n) for a, x, n in zip(args, xs, names)]) if xs else F.struct(*whole)
            if modifier == "unique":
                agg = A.unique(out, row, F.collect_list)
            elif modifier:
                agg = A.Agg(out, F.sort_array(F.collect_set(row)))
            else:
                held_rows = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], row.alias("r"))
                agg = A.Agg(out, F.transform(F.sort_array(F.collect_list(F.when(row.isNotNull(), held_rows))), lambda x: x["r"]))
        elif name == "collect_row":
            agg = A.row_map(out, F.expr(xs[0]), F.expr(xs[1]), order)
        else:
            agg = A.Agg(out, self.low.engine.aggregates[name](*[F.expr(x) for x in xs]))
        frame = self.low.spark.createDataFrame([], T.StructType(list({f.name: f for f in self.fields()}.values())))
        kind = (A.aggregate(frame, [], [agg])).schema[out].dataType
        self.aggs = held
        self.aggs.append(agg)
        self.add(out, kind)
        return f"`{out}`"

    def rows_of(self, q) -> Column:
        """A sub-query over the rows of a group: its items for each row, null where its condition fails."""
        if not isinstance(q, Query) or q.group or q.joins or q.order or q.limit or q.distinct or any(has_aggregate(e, self.low) for e, _ in q.items):
            raise QueryError("unsupported", "over a group's rows a query may only project and filter")
        fields = []
        for e, a in q.items:
            if e[0] == "star":
                fields += [f"`{i}` as `{c}`" for b in self.bounds for c, i in b.columns.items()]
            else:
                fields.append(f"{self.sql(e)} as `{a}`")
        row = F.expr(f"struct({', '.join(fields)})")
        return row if q.where is None else F.when(F.expr(self.condition(q.where, True)), row)

    def constant(self, e: tuple) -> str:
        if e[0] == "unary":
            return e[1] + self.constant(e[2])
        if e[0] == "param":
            v = self.bound_value(e[1])
            if not isinstance(v, str | int | float):
                raise QueryError("arguments", "a plain value is needed here", expression=f":{e[1]}")
            return str(v)
        if e[0] not in ("number", "string"):
            raise QueryError("arguments", "a constant is needed here", expression=str(e[1:]))
        return e[1]

    # predicates
    def _and(self, a: tuple, b: tuple, bare: bool = False) -> str:
        return f"({self.guarded(a, bare)} and {self.guarded(b, bare)})"

    def guarded(self, e: tuple, bare: bool = False) -> str:
        """A condition without a third truth value, unless null counts as false anyhow."""
        s = self.condition(e, bare)
        return s if bare or e[0] in ("compare", "and", "or", "like", "between", "in", "exists") or e[0] == "is" and e[2] == "null" else f"coalesce({s}, false)"

    def _or(self, a: tuple, b: tuple) -> str:
        return f"({self.guarded(a)} or {self.guarded(b)})"

    def _not(self, e: tuple) -> str:
        return f"(not {self.condition(e)})"

    def _compare(self, op: str, a: tuple, b: tuple, bare: bool = False) -> str:
        x, y = (self.sql(s, True) if s[0] == "query" else self.sql(s) for s in (a, b))
        out = compare(self, op, x, y)
        return out[len("coalesce(") : -len(", false)")] if bare else out

    def _is(self, e: tuple, what: str, negated: bool) -> str:
        x = self.sql(e)
        if what == "null":
            return f"({x} is {'not ' * negated}null)"
        return f"({truth(self, x)} = {str((what == 'true') != negated).lower()})"

    def _like(self, e: tuple, p: tuple, negated: bool) -> str:
        return call(self, "str_nlike" if negated else "str_like", [self.sql(e), self.sql(p)])

    def _between(self, e: tuple, lo: tuple, hi: tuple, negated: bool) -> str:
        out = between(self, self.sql(e), self.sql(lo), self.sql(hi))
        return f"(not {out})" if negated else out

    def _in(self, e: tuple, inner, negated: bool, bare: bool = False) -> str:
        x = self.sql(e)
        if not isinstance(inner, list):
            col = "__in"
            sub = self.low.text_query(inner, self, [col], extra=lambda s, c: compare(s, "=", c, x)[len("coalesce(") : -len(", false)")])
            return f"{'not ' * negated}exists ({sub})"
        parts = []
        for i in inner:
            y = self.sql(i)
            if isinstance(self.type(y), T.ArrayType):
                have, want = alike(self, y, f"array({x})")
                parts.append(f"coalesce(array_contains({have}, get({want}, 0)), false)")
            else:
                parts.append(compare(self, "=", x, y))
        if all(i[0] in ("number", "string") for i in inner):
            plain = f"{x} in ({', '.join(self.sql(i) for i in inner)})"
            same = all(numeric(self.type(x)) == (i[0] == "number") for i in inner) and not temporal(self.type(x))
            parts = [plain if bare and not negated else f"coalesce({plain}, false)"] if same else parts
        out = f"({' or '.join(parts)})"
        return f"(not {out})" if negated else out

    def _exists(self, q, bare: bool = False) -> str:
        return f"exists ({self.low.text_query(q, self, None)})"

    def _query(self, q, bare: bool = False) -> str:
        """A scalar sub-query: the first row as a struct, or in comparisons its only column."""
        return f"({self.low.text_query(q, self, None, first='value' if bare else 'row')})"


class Lowering:
    def __init__(self, engine, params, settings: dict) -> None:
        self.engine, self.spark, self.params, self.settings = engine, engine.spark, params, dict(settings)
        self.views: list[str] = []
        self.named_queries: dict[str, Result] = {}

    def lookup(self, name: str) -> Result:
        return self.named_queries[name] if name in self.named_queries else self.engine.lookup(name)

    @property
    def compat(self) -> bool:
        return self.settings.get("mode", "compat") == "compat"

    def view(self, df: DataFrame) -> str:
        name = f"sluice_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        self.views.append(name)
        return name

    # sources
    def bound(self, alias: str, r: Result, columns: list[str] | None = None) -> Bound:
        shown = [c for c in r.df.columns if not c.startswith("__")]
        names = dict(zip(shown, columns)) if columns else {}
        renamed = r.df.select(*[F.col(f"`{c}`").alias(f"{alias}__{c}") for c in r.df.columns])
        return Bound(alias, renamed, {names.get(c, c): f"{alias}__{c}" for c in shown}, [f"{alias}__{c}" for c in r.order], r.time and f"{alias}__{r.time}")

    def source(self, s: Source | None, k: int, outer: Scope | None = None) -> Bound:
        if s is None:
            return Bound("", self.spark.range(1).withColumnRenamed("id", "__one"), {}, ["__one"])
        alias = s.alias or (s.name if s.kind == "table" else f"$t{k}")
        if s.kind == "table":
            t = self.lookup(s.name)
            return self.bound(alias, t, s.columns)
        if s.kind == "query":
            return self.bound(alias, self.query(s.query, outer), s.columns)
        if s.kind == "values":
            return self.values(s, alias, outer)
        if s.name == "zip":
            parts = {x.alias or f"${i}": self.named(x) for i, x in enumerate(s.args)}
            df = M.zip_sources({n: (r.df, r.order) for n, r in parts.items()})
            return self.bound(alias, Result(df.withColumnRenamed("__index", "__ord"), ["__ord"]))
        if s.name == "combine":
            parts = {x.alias or f"${i}": self.named(x) for i, x in enumerate(s.args)}
            df = M.combine_latest({n: (r.df, at := r.time or r.order[0], [c for c in r.order if c != at and c in r.df.columns]) for n, r in parts.items()})
            return self.bound(alias, Result(df, ["__at", "__source"], "__at"))
        if s.name == "merge_by_key":
            return self.merge(s, alias)
        if s.name in ("unnest", "explode"):
            one = Bound("", self.spark.range(1).withColumnRenamed("id", "__one"), {}, ["__one"])
            return self.unnest(one, s, alias, False, outer)
        if s.name in self.engine.sources:
            scope = Scope(self, [])
            return self.bound(alias, self.engine.sources[s.name](*[scope.constant(a) for a in s.args]), s.columns)
        raise QueryError("unsupported", "unknown source", expression=s.name)

    def named(self, x) -> Result:
        if isinstance(x, Source):
            return self.query(x.query)
        return self.lookup(".".join(x[1]))

    def values(self, s: Source, alias: str, outer: Scope | None) -> Bound:
        scope = Scope(self, [], outer)
        width = max(map(len, s.args))
        names = s.columns or [f"${i}" for i in range(width)]
        lines = [f"select {i} as __ord, " + ", ".join(f"{scope.sql(e)} as `{n}`" for e, n in zip(r, names)) for i, r in enumerate(s.args)]
        return self.bound(alias, Result(self.spark.sql(" union all ".join(lines)), ["__ord"]))

    def merge(self, s: Source, alias: str) -> Bound:
        words = [a[1] if isinstance(a, tuple) and a[0] in ("string", "number") else None for a in s.args]
        first = words[0] is not None
        tables, options, key = {}, {}, words[0] if first else None
        for a, w in zip(s.args[first:], words[first:]):
            if isinstance(a, Source) or a[0] == "column":
                base = a.alias if isinstance(a, Source) else a[1][-1]
                name, n = base, 1
                while name in tables:
                    n += 1
                    name = f"{base}_{n}"
                tables[name] = self.named(a)
            elif w in M.MODES:
                options["mode"] = w
            elif w in M.DUPLICATES:
                options["duplicates"] = w
            elif w in ("asc", "desc"):
                options["descending"] = w == "desc"
            elif a[0] == "number":
                options["max_rows"] = int(w)
            elif key is None:
                key = w
            else:
                raise QueryError("invalid_option", "merge_by_key", expression=str(w))
        down = options.get("descending", False)
        frames, order = {}, {}
        for n, r in tables.items():
            df = r.df
            if key in df.columns and r.order and r.order[0] != key and set(r.order) < set(df.columns):
                df = M.check_sorted(df, key, r.order, down, n)  # a source whose rows arrive in another order than the key's
            hidden = [c for c in df.columns if c.startswith("__") and c != "__ord"]
            frames[n] = df.drop(*hidden)
            order[n] = [c for c in r.order if c in frames[n].columns and c != key] or [c for c in frames[n].columns if c != key]
        most = self.settings.get("merge_by_key.maxRowsPerKey")
        if options.get("duplicates", "error") != "error" and most is not None:
            options.setdefault("max_rows", int(most))
        df = M.merge_by_key(frames, key, order=order, **options)
        df = df.drop(*[c for c in df.columns if c.endswith("__ord")])
        if down and isinstance(df.schema[key].dataType, T.NumericType):
            return self.bound(alias, Result(df.withColumn("__ord", -F.col(key)), ["__ord"]))
        return self.bound(alias, Result(df, [key]))

    def unnest(self, left: Bound, s: Source, alias: str, outer_join: bool, outer: Scope | None = None, scope: Scope | None = None) -> Bound:
        if not s.args:
            raise QueryError("arguments", "unnest takes a list", expression=s.name)
        scope = scope or Scope(self, [left], outer)
        args = [scope.sql(a) for a in s.args]
        suffix = "_outer" if outer_join else ""
        names = s.columns
        if len(args) == 1:
            kind = scope.type(args[0])
            if isinstance(kind, T.MapType):
                args, kind = [f"map_entries({args[0]})"], scope.type(f"map_entries({args[0]})")
            spread = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and len(names) > 1
            df = left.df.select("*", F.expr(f"explode{suffix}({args[0]})").alias("__item"))
            fields = kind.elementType.names if spread else []
            cols = {n: F.col("__item").getField(f) for n, f in zip(names, fields)} if spread else {(names or [s.alias or s.name])[0]: F.col("__item")}
        else:
            zipped = f"arrays_zip({', '.join(args)})"
            df = left.df.select("*", F.expr(f"explode{suffix}({zipped})").alias("__item"))
            base = s.alias or s.name
            names = names or [base] + [f"{base}_{i}" for i in range(len(args) - 1)]
            fields = scope.type(zipped).elementType.names
            cols = {n: F.col("__item").getField(f) for n, f in zip(names, fields)}
        df = df.select(*[F.col(f"`{c}`") for c in left.df.columns], *[v.alias(f"{alias}__{n}") for n, v in cols.items()])
        return Bound(alias, df, {n: f"{alias}__{n}" for n in cols}, left.order)

    # correlated and scalar sub-queries as text
    def text_query(self, q, outer: Scope, names: list[str] | None, extra=None, first: str | None = None) -> str:
        if isinstance(q, SetQuery) or q.group or q.distinct or q.joins and any(j.source.kind != "table" for j in q.joins):
            r = self.query(q)
            cols = [c for c in r.df.columns if not c.startswith("__")]
            view = self.view(r.df.select(*[F.col(f"`{c}`").alias(f"__s{i}") for i, c in enumerate(cols)]))
            if extra:
                inner = Scope(self, [Bound("", r.df.select(F.col(f"`{cols[0]}`").alias("__s0")), {}, [])], outer)
                return f"select 1 from {view} where {extra(inner, '`__s0`')}"
            if first:
                row = "`__s0`" if first == "value" else "struct(" + ", ".join(f"`__s{i}` as `{c}`" for i, c in enumerate(cols)) + ")"
                return f"select first({row}) from {view}"
            return f"select 1 from {view}" if names is None else f"select * from {view}"
        tag = uuid.uuid4().hex[:6]
        bounds = []
        for k, s in enumerate([q.source, *[j.source for j in q.joins]]):
            b = self.source(s, k, outer)
            fresh = {i: f"{tag}_{i}" for i in b.df.columns}
            bounds.append(Bound(b.alias, b.df.select(*[F.col(f"`{i}`").alias(n) for i, n in fresh.items()]), {c: fresh[i] for c, i in b.columns.items()}, [fresh[i] for i in b.order]))
        scope = Scope(self, bounds, outer)
        scope.in_text = True
        conds = [scope.condition(j.on, True) for j in q.joins if j.on] + ([scope.condition(q.where, True)] if q.where else [])
        items = []
        for e, a in q.items:
            if e[0] == "star":
                items += [(f"`{i}`", c) for b in scope.bounds for c, i in b.columns.items()]
            else:
                items.append((scope.sql(e), a or "value"))
        if extra:
            conds.append(extra(scope, items[0][0]))
        source = " cross join ".join(self.view(b.df) for b in bounds)
        where = f" where {' and '.join(conds)}" if conds else ""
        outer.used_outer |= scope.used_outer
        self.last_correlated = scope.used_outer
        grouped = any(has_aggregate(e, self) for e, _ in q.items)
        if first:
            inner = items[0][0] if first == "value" else "struct(" + ", ".join(f"{s} as `{a}`" for s, a in items) + ")"
            return f"select {inner if grouped else f'first({inner})'} from {source}{where}"
        if names is None or extra:
            return f"select 1 from {source}{where}"
        shown = ", ".join(f"{s} as `{n}`" for (s, _), n in zip(items, names)) if names else ", ".join(f"{s} as `{a}`" for s, a in items)
        limit = f" limit {scope.constant(q.limit)}" if q.limit else ""
        return f"select {shown} from {source}{where}{limit}"

    # queries
    def query(self, q, outer: Scope | None = None) -> Result:
        if isinstance(q, With):
            for name, columns, inner in q.names:
                r = self.query(inner, outer)
                shown = [c for c in r.df.columns if not c.startswith("__")]
                if columns and len(columns) != len(shown):
                    raise QueryError("arguments", f"{name} has {len(shown)} columns", expression=", ".join(columns))
                to = dict(zip(shown, columns or shown))
                self.named_queries[name] = Result(r.df.withColumnsRenamed(to), [to.get(c, c) for c in r.order], to.get(r.time, r.time))
            return self.query(q.body, outer)
        if isinstance(q, SetQuery):
            left, right = self.query(q.left, outer), self.query(q.right, outer)
            hide = lambda df: df.drop(*[c for c in df.columns if c.startswith("__")])
            df = M.set_operation(q.kind, hide(left.df), hide(right.df), self.compat)
            return Result(df, list(df.columns))
        held = self.settings
        self.settings = held | q.hints
        try:
            return self.select(q, outer)
        finally:
            self.settings = held

    def join(self, bounds: list[Bound], df: DataFrame, order: list[str], j, k: int) -> tuple[DataFrame, Bound]:
        left = Bound("", df, {}, order)
        scope = Scope(self, bounds)
        scope.extra = list(df.schema)
        s = j.source
        alias = s.alias or (s.name if s.kind == "table" else f"$t{k}")
        if s.kind == "call" and s.name in ("unnest", "explode"):
            b = self.unnest(left, s, alias, j.kind == "left", scope=scope)
            return b.df, Bound(alias, b.df, b.columns, order)
        if s.kind == "query" and isinstance(s.query, Query) and not s.query.group and not s.query.order:
            names = [a for _, a in s.query.items]
            self.last_correlated = False
            if all(names):
                inner = self.text_query(s.query, scope, [f"{alias}__{n}" for n in names])
                if self.last_correlated:
                    on = ""
                    kind = "left join" if j.kind == "left" else "inner join"
                    view = self.view(df)
                    out = self.spark.sql(f"select * from {view} {kind} lateral ({inner}) on true")
                    b = Bound(alias, out, {n: f"{alias}__{n}" for n in names}, order)
                    if j.on:
                        both = Scope(self, [*bounds, b])
                        on = both.condition(j.on, True)
                        out = out.where(F.expr(on))
                    return out, Bound(alias, out, b.columns, order)
        b = self.source(s, k)
        both = Scope(self, [*bounds, b])
        both.extra = list(df.schema)
        if j.on and j.on[0] == "using":
            return self.using(bounds, df, b, j)
        on = F.expr(both.condition(j.on, True)) if j.on else None
        kind = j.kind
        if self.compat and kind == "right" and on is not None:
            return M.right_join_per_left_row(df, b.df, on), b
        if self.compat and kind not in ("left", "right"):
            kind = "inner"
        how = {"left semi": "left_semi", "left anti": "left_anti"}.get(kind, "inner" if kind in ("cross", "natural") else kind)
        return (df.crossJoin(b.df) if on is None else df.join(b.df, on, how)), b

    def using(self, bounds: list[Bound], df: DataFrame, b: Bound, j) -> tuple[DataFrame, Bound]:
        """A join on columns of equal names; each stands once, with the value of whichever side has one."""
        pairs = []
        for c in j.on[1]:
            left = next((x.columns[c] for x in bounds if c in x.columns), None)
            if left is None or c not in b.columns:
                raise QueryError("unknown_name", "no such column on both sides", expression=c)
            pairs.append((left, b.columns[c]))
        both = Scope(self, [*bounds, b])
        both.extra = [*df.schema, *b.df.schema]
        on = F.expr(" and ".join(compare(both, "=", f"`{x}`", f"`{y}`")[len("coalesce(") : -len(", false)")] for x, y in pairs))
        out = df.join(b.df, on, {"left semi": "left_semi", "left anti": "left_anti", "cross": "inner", "natural": "inner"}.get(j.kind, j.kind))
        if j.kind in ("right", "full"):
            out = out.withColumns({x: F.coalesce(x, y) for x, y in pairs})
        return out, b

    def select(self, q: Query, outer: Scope | None) -> Result:
        first = self.source(q.source, 0, outer)
        bounds, df, order = [first], first.df, first.order
        for k, j in enumerate(q.joins):
            df, b = self.join(bounds, df, order, j, k + 1)
            bounds.append(b)
        for b in bounds:
            b.df = b.df.select(*[c for c in b.df.columns if c in df.columns])
        scope = Scope(self, bounds, outer)
        scope.extra = list(df.schema)
        scope.low_order = order
        if q.where is not None:
            df = df.where(F.expr(scope.condition(q.where, True)))
        if mentions(q, "row.index") or mentions(q, "row.elapsed"):
            by = [f"`{c}`" for c in order]
            timed = first.time and mentions(q, "row.elapsed")
            df = R.index_and_elapsed(df, by, F.col(f"`{first.time}`"), "__row_index", "__row_elapsed") if timed else R.global_index(df, by, "__row_index")
            for name in ["index", "elapsed"][: 1 + bool(timed)]:
                scope.fixed[f"row.{name}"] = f"`__row_{name}`"
                scope.add(f"__row_{name}", T.LongType())
        grouped = bool(q.group) or any(has_aggregate(e, self) for e, _ in q.items)
        return self.grouped(q, scope, df, order, first.time) if grouped else self.plain(q, scope, df, order, first.time)

    def limits(self, q: Query, scope: Scope) -> tuple[int, int | None]:
        return int(scope.constant(q.offset)) if q.offset else 0, int(scope.constant(q.limit)) if q.limit else None

    def ordering(self, q: Query, scope: Scope) -> list:
        out = []
        for e, down, nulls in q.order:
            c = F.expr(scope.sql(e))
            nulls = nulls or ("last" if down else "first")
            out.append(getattr(c, f"{'desc' if down else 'asc'}_nulls_{nulls}")())
        return out

    def items(self, q: Query, scope: Scope) -> list[tuple[str, str]]:
        out: dict[str, str] = {}
        stars: dict[str, str] = {}
        for e, a in q.items:
            if e[0] == "star":
                some = [b for b in scope.bounds if e[1] is None or b.alias == e[1]]
                (stars if e[1] is None else out).update({c: f"`{i}`" for b in some for c, i in b.columns.items()})
                continue
            sql = scope.sql(e)
            out[a] = sql
            scope.aliases.setdefault(a, sql)
        return list((out | stars).items())

    def project(self, df: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
        df = df.select("*", *[F.expr(s).alias(f"__out{i}") for i, (_, s) in enumerate(items)])
        cols = []
        for i, (name, _) in enumerate(items):
            if name == "$this" and isinstance(df.schema[f"__out{i}"].dataType, T.StructType):
                cols.append(F.col(f"__out{i}.*"))
            else:
                cols.append(F.col(f"__out{i}").alias(name))
        return df.select(*cols)

    def plain(self, q: Query, scope: Scope, df: DataFrame, order: list[str], time: str | None) -> Result:
        items = []
        for k, (e, a) in enumerate(q.items):
            own = self.engine.expansions.get(e[1]) if e[0] == "call" else None
            if e[0] == "call" and (own or e[1] in EXPANSIONS):
                if not own and len(e[2]) != 1:
                    raise QueryError("arguments", f"{e[1]} takes one list", expression=e[1])
                x = own(*[scope.sql(a) for a in e[2]]) if own else scope.sql(e[2][0])
                x = x if isinstance(scope.type(x), T.ArrayType) else f"array_compact(array({x}))"
                kind = scope.type(x).elementType
                df = df.select("*", F.explode(F.expr(x)).alias(f"__x{k}"))
                scope.add(f"__x{k}", kind)
                scope.aliases[a] = f"`__x{k}`"
                items.append(((*e[:1], f"__x{k}"), a))
                scope.fixed[f"__x{k}"] = f"`__x{k}`"
                items[-1] = (("column", [f"__x{k}"]), a)
            else:
                items.append((e, a))
        shown = self.items(Query(items=items), scope)
        if q.distinct:
            if q.distinct_on:
                keys = [scope.sql(e) for e in q.distinct_on if e[0] != "star"] or [f"`{i}`" for b in scope.bounds for i in b.columns.values()]
                df = df.withColumns({f"__d{i}": F.expr(s) for i, s in enumerate(keys)})
                df = R.distinct_on(df, [f"__d{i}" for i in range(len(keys))], [f"`{c}`" for c in order])
            elif by_name := scope.setting("distinctBy", None):
                df = self.engine.distinct_by(by_name)(df, [i for b in scope.bounds for i in b.columns.values()], order)
            elif self.compat:
                df = df.dropDuplicates([i for b in scope.bounds for i in b.columns.values()])
        by = self.ordering(q, scope)
        offset, limit = self.limits(q, scope)
        if (size := int(scope.setting("orderBy.windowSize", 0))) and by:
            df = R.window_sort(df, [f"`{c}`" for c in order], by, size)
        elif q.distinct and not q.distinct_on and not self.compat:
            out = self.project(df, shown).distinct()
            return Result(R.top(out, [], offset, limit), list(out.columns))
        elif by and limit is None and (most := scope.setting("orderBy.maxRows", None)):
            df = R.guard(df, int(most), "ORDER BY").orderBy(*by)
        else:
            df = R.top(df, by, offset, limit) if by or limit is not None or offset else df
        out = self.project(df, shown)
        names = {s.strip("`"): n for n, s in shown}
        if q.order and not size:  # the rows now arrive in this order, as far as plain ascending columns say it
            sorted_by = [names.get(scope.sql(e).strip("`")) for e, down, nulls in q.order if not down and nulls != "last"]
            if None not in sorted_by and len(sorted_by) == len(q.order):
                return Result(out, sorted_by, names.get(time) if time else None)
        kept = [names[c] for c in order if c in names]
        return Result(out, kept if len(kept) == len(order) else list(out.columns), names.get(time) if time else None)

    def grouped(self, q: Query, scope: Scope, df: DataFrame, order: list[str], time: str | None) -> Result:
        keys, shown_keys, levels = [], {}, []
        quoted = [f"`{c}`" for c in order]
        for k, e in enumerate(q.group):
            name = f"__k{k}"
            special = e[1] if e[0] == "call" else ""
            if special in self.engine.groupings:
                df = self.engine.groupings[special](df, keys, order, [scope.constant(a) for a in e[2]], name)
                scope.add(name, df.schema[name].dataType)
                keys.append(name)
                levels.append(name)
                continue
            if special in ("interval", "_window") or special in ("take", "trace"):
                args = [scope.constant(a) for a in e[2]]
                texts = [a[0] == "string" for a in e[2]]
                if special == "take":
                    df = R.take(df, keys, quoted, *[int(a) for a in args])
                    continue
                if special == "trace":
                    df = R.index_in(df.drop("__row_index"), keys, quoted, "__row_index")
                    scope.fixed["row.index"] = "`__row_index`"
                    scope.add("__row_index", T.LongType())
                    continue
                if special == "interval" or all(texts):
                    if not time:
                        raise QueryError("arguments", "the source has no time column", expression=special)
                    df = G.tumbling_time(df, F.col(f"`{time}`"), millis(args[0]), name, millis(args[1]) if len(args) > 1 else None)
                    scope.add(name, T.TimestampType())
                elif len(args) == 2 and texts == [False, True]:
                    df = G.count_or_timeout(df, keys, order, time, int(args[0]), millis(args[1]), name)
                    scope.add(name, T.LongType())
                else:
                    df = G.count_windows(df, keys, quoted, int(args[0]), name, int(args[1]) if len(args) > 1 else None)
                    scope.add(name, T.LongType())
                keys.append(name)
                if special == "interval":
                    levels.append(name)
                scope.fixed["_window_start"] = f"`{name}`"
                continue
            if e[0] in ("number", "string", "case", "star"):
                raise QueryError("unsupported", "this can't be grouped by", expression=str(e[1:]))
            sql = scope.sql(e)
            kind = scope.type(sql)
            df = df.withColumn(name, F.expr(sql))
            if self.compat:
                df = df.where(F.col(name).isNotNull())
            scope.add(name, kind)
            scope.keys[sql] = name
            keys.append(name)
            levels.append(name)
            if e[0] == "column":
                shown_keys[e[1][-1]] = f"`{name}`"
        if levels:
            scope.fixed["_group_by_key"] = "array(" + ", ".join(f"cast(`{n}` as string)" for n in levels) + ")" if len(levels) > 1 else f"array(`{levels[0]}`)"
        scope.low_order = order
        aggregated = any(has_aggregate(e, self) for e, _ in q.items)
        scope.aggs = []
        if q.group and not aggregated and not keys:
            return self.plain(Query(items=q.items, order=q.order, limit=q.limit, offset=q.offset), self.reset(scope), df, order, time)
        shown = []
        for e, a in q.items:
            if e[0] == "star":
                shown += [(c, scope.last(f"`{i}`")) for b in scope.bounds if e[1] in (None, b.alias) for c, i in b.columns.items()]
                continue
            sql = scope.sql(e)
            shown.append((a, sql))
            if not scope_has(scope, a):
                scope.aliases[a] = sql
        having = scope.condition(q.having, True) if q.having is not None and q.group else None
        by = self.ordering(q, scope)
        if aggregated:
            shown += [(n, s) for n, s in shown_keys.items() if n not in dict(shown) and s not in dict(shown).values()]
        out = A.aggregate(df, keys, scope.aggs)
        first = q.group[0] if len(q.group) == 1 else ("", "")
        if first[0] == "call" and first[1] == "interval" and len(first[2]) == 1 and scope.setting("interval.empty", "false") in ("true", True):
            counts = {a.name: 0 for a, in ((x,) for x in scope.aggs) if a.name in scope.counts}
            out = G.dense(out, keys[0], millis(scope.constant(first[2][0])), counts)
        if having:
            out = out.where(F.expr(having))
        offset, limit = self.limits(q, scope)
        if by or limit is not None or offset:
            out = R.top(out, by, offset, limit)
        takes = [a for e, a in q.items if e[0] == "call" and e[1] == "take"]
        out = self.project(out, shown)
        if takes and sum(has_aggregate(e, self) for e, _ in q.items) == 1:
            out = out.withColumn(takes[0], F.explode(F.col(f"`{takes[0]}`")))
        return Result(out.distinct() if q.distinct else out, list(out.columns))

    def reset(self, scope: Scope) -> Scope:
        scope.aggs = None
        return scope


def scope_has(scope: Scope, name: str) -> bool:
    return any(name in b.columns for b in scope.bounds)


def has_aggregate(e, low: Lowering) -> bool:
    if isinstance(e, tuple) and e and e[0] == "call" and (e[1] in AGGREGATES or e[1] in low.engine.aggregates):
        return True
    return isinstance(e, tuple | list) and any(has_aggregate(x, low) for x in e if isinstance(x, tuple | list))


def mentions(q, name: str) -> bool:
    def look(e) -> bool:
        if isinstance(e, tuple) and len(e) == 2 and e[0] == "column":
            return ".".join(e[1]) == name
        return isinstance(e, tuple | list) and any(map(look, e))

    return look(q.items) or look(q.order) or look(q.group) or q.where is not None and look(q.where)
