"""Several sources into one: by position, by latest value, by sorted key; and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from .rows import before, carried, global_index, in_ranges, previous


def row_of(df: DataFrame, hidden: list[str] = ()) -> F.Column:
    return F.struct(*[f"`{c}`" for c in df.columns if c not in hidden])


def zip_sources(sources: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows of equal position, as one struct per source; ends with the shortest source. sources: name -> (rows, order)."""
    sides = [global_index(df, order, "__i").select("__i", row_of(df).alias(name)) for name, (df, order) in sources.items()]
    return reduce(lambda a, b: a.join(b, "__i"), sides).withColumnRenamed("__i", "__index")


def combine_latest(sources: dict[str, tuple[DataFrame, str, list[str]] | tuple[DataFrame, str]], partition: list[str] | None = None) -> DataFrame:
    """A row on each arrival once all sources have one: the latest row of each. sources: name -> (rows, time column, columns
    of arrival that order rows of one time).

    Without a partition column the latest values run over one ordered sequence, in ranges that hand over the latest row
    of each source; with one, over each key's.
    """
    names, keys = list(sources), partition or []
    parts, by = [], ["__at", "__source"]
    for k, (name, (df, at, *then)) in enumerate(sources.items()):
        row = row_of(df)
        ties = {f"__t{k}_{i}": c for i, c in enumerate(then[0] if then else [])}  # null in the rows of other sources
        parts.append(df.select(*keys, F.col(at).alias("__at"), F.lit(k).alias("__source"), row.alias(name), *[F.col(f"`{c}`").alias(t) for t, c in ties.items()]))
        by += ties
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not keys:
        both = in_ranges(both, by)
    w = W.partitionBy(*(keys or ["__p"])).orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = [F.last(n, ignorenulls=True).over(w).alias(n) for n in names]
    if keys:
        out = both.select(*keys, "__at", "__source", *latest)
    else:
        at = F.struct(*by)
        ends = carried(both, [F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in names], [F.last(n, ignorenulls=True).over(before()).alias(f"__b{k}") for k, n in enumerate(names)])
        inside = both.select("__p", "__at", "__source", *latest).join(F.broadcast(ends), F.col("__p") == F.col("__q"), "left")  # a row per range; each has one
        out = inside.select("__at", "__source", *[F.coalesce(n, f"__b{k}").alias(n) for k, n in enumerate(names)])
    return out.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))


#: Names of modes; fixed values of the dialect.
MODES = {m: m for m in ("inner", "left", "right", "full")} | {"left_outer": "left", "right_outer": "right", "outer": "full", "full_outer": "full"}
DUPLICATES = {"error", "zip", "cartesian", "array", "list"}


def merge_by_key(
    sources: dict[str, DataFrame], key: str, mode: str = "full", duplicates: str = "error", descending: bool = False,
    order: dict[str, list[str]] | None = None, max_rows: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Merge sources on one key. mode: keys of all, the first, the last or any source. duplicates: an error, i-th with
    i-th, the product, or lists. Equal columns of several sources collapse; a later, different value stands in
    ``source.column``. A null key is an error, and so are more than max_rows rows of a key in a source, if given."""
    if mode not in MODES or duplicates not in DUPLICATES:
        raise QueryError("invalid_option", f"no mode {mode} with duplicates {duplicates}")
    mode, names = MODES[mode], list(sources)
    lists = duplicates in ("array", "list")
    sides, columns = [], {}
    for k, (name, df) in enumerate(sources.items()):
        if key not in df.columns:
            raise QueryError("unknown_name", f"source {name} has no column", expression=key)
        columns[name] = [c for c in df.columns if c != key]
        checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"merge_by_key: null key in {name}"))).otherwise(F.col(key))
        df = df.withColumn(key, checked)
        if duplicates == "error":  # one aggregate by the key finds the duplicates, and the join needs no other shuffle
            rest = row_of(df, [key]) if columns[name] else F.struct(F.lit(1).alias("one"))
            one = df.groupBy(key).agg(F.count("*").alias("__n"), F.first(rest).alias("__r"))
            unique = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"merge_by_key: duplicate key in {name}"))).otherwise(F.col(key))
            df = one.select(unique.alias(key), *[F.col("__r").getField(c).alias(c) for c in columns[name]])
        elif max_rows is not None:
            n = F.count("*").over(W.partitionBy(key))
            df = df.withColumn(key, F.when(n > max_rows, F.raise_error(F.lit(f"merge_by_key: over {max_rows} rows of a key in {name}"))).otherwise(F.col(key)))
        if lists:
            sort = [f"`{c}`" for c in (order or {}).get(name, columns[name])]
            rows = F.array_sort(F.collect_list(F.struct(F.struct(*sort).alias("o"), row_of(df).alias("r"))))
            df = df.groupBy(key).agg(F.transform(rows, lambda x: x["r"]).alias(name))
        else:
            df = df.select(key, *[F.col(f"`{c}`").alias(f"__{k}.{c}") for c in columns[name]])
            if duplicates == "zip":
                by = [f"`__{k}.{c}`" for c in (order or {}).get(name, columns[name])]
                df = df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*by)))
        sides.append(df.withColumn(f"__p{k}", F.lit(True)))
    on = [key, "__rn"] if duplicates == "zip" else [key]
    out = reduce(lambda a, b: a.join(b, on, "full"), sides)
    here = [F.coalesce(F.col(f"__p{k}"), F.lit(False)) for k in range(len(names))]
    if mode == "inner":
        out = out.where(reduce(lambda a, b: a & b, here))
    elif mode != "full":
        one = here[0 if mode == "left" else -1]
        if duplicates == "zip":  # a source's presence is per key, not per row
            one = F.max(one).over(W.partitionBy(key))
            out = out.withColumn("__keep", one).where("__keep").drop("__keep")
        else:
            out = out.where(one)
    if lists:
        out = out.select(key, *[F.coalesce(n, F.array()).alias(n) for n in names])
        return out.orderBy(F.desc(key) if descending else F.asc(key)) if ordered else out
    shown = [F.col(key)]
    every = list(dict.fromkeys(c for n in names for c in columns[n]))
    for c in every:
        holders = [(k, n) for k, n in enumerate(names) if c in columns[n]]
        values = [F.col(f"`__{k}.{c}`") for k, _ in holders]
        first = F.coalesce(*values)
        shown.append(first.alias(c))
        for (_, n), v in list(zip(holders, values))[1:]:
            shown.append(F.when(v.isNotNull() & ~v.eqNullSafe(first), v).alias(f"{n}.{c}"))
    by = F.desc(key) if descending else F.asc(key)
    return (out.orderBy(by, *(["__rn"] if duplicates == "zip" else [])) if ordered else out).select(*shown)


def check_sorted(df: DataFrame, key: str, order: list[str], descending: bool = False, name: str = "a source") -> DataFrame:
    """Raise at the first row whose key stands before that of the row that arrived earlier."""
    before = F.col("__before")
    wrong = (before < F.col(key)) if descending else (before > F.col(key))
    why = F.raise_error(F.concat(F.lit(f"merge_by_key: {name} isn't sorted {'descending' if descending else 'ascending'}: "), F.col(key).cast("string"), F.lit(" after "), before.cast("string")))
    return previous(df, order, F.col(key), "__before").withColumn(key, F.when(wrong, why).otherwise(F.col(key))).drop("__before")


def set_operation(kind: str, left: DataFrame, right: DataFrame, compat: bool = True) -> DataFrame:
    """UNION [ALL], MINUS, EXCEPT and INTERSECT by column names. In compat mode EXCEPT is right minus left."""
    if kind == "union all":
        return left.unionByName(right, allowMissingColumns=True)
    if kind == "union":
        return left.unionByName(right, allowMissingColumns=True).distinct()
    right = right.select(*left.columns)
    if kind == "except" and compat:
        return right.subtract(left)
    return left.intersect(right) if kind == "intersect" else left.subtract(right)


def right_join_per_left_row(left: DataFrame, right: DataFrame, on: F.Column) -> DataFrame:
    """The dialect's right join: every right row once per left row, with the left columns only where the condition
    holds. A product by definition; standard right joins are the ansi mode's."""
    both = left.crossJoin(right)
    hit = F.coalesce(on, F.lit(False))
    return both.select(*[F.when(hit, F.col(f"`{c}`")).alias(c) for c in left.columns], *[f"`{c}`" for c in right.columns])
