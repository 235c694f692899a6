"""The dialect on small rows with known answers, the catalogue against DuckDB, and the streams."""

import datetime
import decimal
import glob
import json
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sluice import catalog, sources, streaming
from sluice.errors import QueryError
from sluice.operators import merging, rows
from sluice.session import Engine
from sluice.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("t", sources.scalars(spark, [1, 2, 3, 4, 5, 6]))
    e.register("u", sources.scalars(spark, [1, 1, 2, 2, 3, 5]))
    e.register("t1", sources.rows(spark, [("a", 0), ("b", 1)], "name string, v int"))
    e.register("t2", sources.rows(spark, [("c", 0), ("d", 1)], "name string, v int"))
    e.register("wide", sources.rows(spark, [('{"a": "long enough"}',)], "name string"))
    e.register("f1", spark.createDataFrame([(1, "a1"), (2, "a2"), (4, "a4")], "ts int, a string"))
    e.register("f2", spark.createDataFrame([(1, "b1"), (3, "b3"), (4, "b4")], "ts int, b string"))
    return e


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select sum(this) s from t group by _window(3)", [(6.0,), (15.0,)]),
        ("select sum(this) s from t group by _window(3, 1)", [(6.0,), (6.0,), (9.0,), (11.0,), (12.0,), (15.0,)]),
        ("select avg(unique this) a, avg(distinct this) d, count(unique this) c from u", [(4.0, 2.75, 2)]),
        ("select take(this, 3, -2) x from t group by _window(5)", [(2,), (3,), (6,)]),
        ("/*+ orderBy.windowSize(2) */ select this from t order by this desc", [(1,), (2,), (3,), (4,), (5,), (6,)]),
        ("select t1.name a, t2.name b from t1 right join t2 on t1.v = t2.v", [(None, "c"), (None, "d"), ("a", "c"), ("b", "d")]),
        ("select ts, a, b from merge_by_key('ts', f1, f2)", [(1, "a1", "b1"), (2, "a2", None), (3, None, "b3"), (4, "a4", "b4")]),
        ("select ts from merge_by_key('ts', f1, f2, 'inner')", [(1,), (4,)]),
        ("select a.this x, b.this y from zip((select this from t limit 2) a, (select this from u) b) z", [(1, 1), (2, 1)]),
        ("select round(12.345, 2) a, substr('abc', 1) b, substring('abcdef', 2, 3) c, 3+2-5*0 d, round(-2.5) e", [(12.35, "bc", "bcd", 5, -2)]),
        ("select datediff('2024-02-10', '2024-02-01') a, 7 / 2 b, regexp_extract('ab', 'z') c", [(9, 3, None)]),
        ("select '{\"a\":{\"b\":[1,7]}}'->'a'->'b'->>1 x, json_merge_patch('{\"a\":1}', '{\"a\":null}') y", [("7", "{}")]),
        ("select name from t1 where v not in (select v from t2 where v > 0)", [("a",)]),
        ("select this from t where this > ? and this < :1", [(3,)]),
        ("select take(unique this, 2) x from u", [(3,), (5,)]),
        ("select take(distinct this, 3, -1) x from u", [(3,)]),
        ("select v, collect_list((select name n from t1 where v > 0)) l from t1 group by v", [(0, []), (1, [("b",)])]),
        ("with x as (select this v from t where this > 4), y(w) as (select v * 2 from x) select w from y", [(10,), (12,)]),
        ("select cast('1.5' as double precision) a, array[1, 'a'] b, new_map('a', 1, 'b', 'x') c", [(1.5, ["1", "a"], {"a": "1", "b": "x"})]),
        ("/*+ mode(ansi) */ select v, t1.name a, t2.name b from t1 full join t2 using (v)", [(0, "a", "c"), (1, "b", "d")]),
        ("select math.copy_sign(3, -0.0) a, in(1, '1', 2) b, contains_any(array['1'], 1) c", [(-3.0, True, True)]),
        ("select json_get('{\"a\":{\"b\":3}}', p) x from (select '$.a.b' p) z", [("3",)]),
    ],
)
def test_known_answers(engine, text, want):
    got = [tuple([tuple(x) for x in c] if isinstance(c, list) and c and not isinstance(c[0], str) else c for c in r) for r in engine.sql(text, [2, 4]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select ts, a, b from merge_by_key('ts', f1, f2)", [(1, "a1", "b1"), (2, "a2", None), (3, None, "b3"), (4, "a4", "b4")]),
        ("select ts, a, b from merge_by_key('ts', f1, f2, 'desc')", [(4, "a4", "b4"), (3, None, "b3"), (2, "a2", None), (1, "a1", "b1")]),
        ("select row.index i, ts from merge_by_key('ts', f1, f2, 'desc')", [(1, 4), (2, 3), (3, 2), (4, 1)]),
        ("select this from t order by this desc limit 3", [(6,), (5,), (4,)]),
        ("select this from t order by this % 2, this desc limit 1, 4", [(4,), (2,), (5,), (3,)]),
        ("/*+ orderBy.windowSize(4) */ select this from t order by this desc", [(4,), (3,), (2,), (1,), (6,), (5,)]),
    ],
)
def test_rows_come_in_order(engine, text, want):
    assert [tuple(r) for r in engine.sql(text).collect()] == want


def test_bound_values(engine):
    """Lists, times and decimals as parameters; a number equals its text."""
    when = datetime.datetime(2024, 3, 1, 12, 30)
    row = engine.sql(
        "select contains_all(array[1, 2, 3], ?) a, contains_all(array[1, 2, 3], ?) b, year(?) c, ? + 1 d, ? e, array_len(?) f, ? g",
        [[1, "2"], [1, 9], when, decimal.Decimal("1.5"), datetime.date(2024, 1, 2), [], {"k": 1}],
    ).first()
    assert tuple(row) == (True, False, 2024, decimal.Decimal("2.5"), datetime.date(2024, 1, 2), 0, {"k": 1})
    assert {r[0] for r in engine.sql("select this from t where this in ? or this in (:1)", [[2, "4"], [6]]).collect()} == {2, 4, 6}
    with pytest.raises(QueryError):
        engine.sql("select ? a, ? b", [1])


@pytest.mark.parametrize("odd", ["x\\y", 'a "q"', "line\nbreak\ttab", "\u0001", "\\", ""])
def test_json_of_any_text(engine, odd):
    row = engine.sql("select json_build_object('k', ?) o, json_array(?, 1) l, json_quote(?) q, json_build_object(?, 2) n, to_json(?) t", [odd] * 5).first()
    assert json.loads(row.o) == {"k": odd} and json.loads(row.l) == [odd, 1] and json.loads(row.q) == odd and json.loads(row.n) == {odd: 2} and json.loads(row.t) == odd


def test_limits(engine):
    for text in (
        "select replace(repeat('a', 1000), 'a', repeat('b', 2000)) x", "select lpad('a', 2000000) x", "select concat_ws(repeat(',', 600000), 'a', 'b', 'c') x",
        "/*+ json.maxLength(10) */ select json_get(n, '$.a') x from (select name n from wide) z", "select regexp_like(repeat('a', 300000), 'b') x", "/*+ orderBy.maxRows(3) */ select this from t order by this",
    ):
        with pytest.raises(Exception, match="resource_limit"):
            engine.sql(text).collect()
    assert engine.sql("select length(lpad('a', 1000000)) n").first()[0] == 1_000_000


def test_merge_checks_its_sources(spark, engine):
    engine.register("unsorted", sources.rows(spark, [(3, "x"), (1, "y")], "ts int, c string"))
    engine.register("many", spark.createDataFrame([(1, f"x{k}") for k in range(6)], "ts int, c string"))
    with pytest.raises(Exception, match="unsorted isn't sorted ascending: 1 after 3"):
        engine.sql("select ts from merge_by_key('ts', f1, unsorted)").collect()
    assert engine.sql("select ts from merge_by_key('ts', f1, (select ts, c from unsorted order by ts) y)").count() == 4
    assert engine.sql("select ts from merge_by_key('ts', f1, unsorted, 'desc')").count() == 4
    assert engine.sql("select ts from merge_by_key('ts', f1, many, 'zip')").count() == 8
    with pytest.raises(Exception, match="over 5 rows"):
        engine.sql("select ts from merge_by_key('ts', f1, many, 'zip', 5)").collect()


@pytest.mark.parametrize("how,count", [("array", 1), ("cartesian", 3000), ("zip", 1500)])
def test_merge_takes_every_row_of_a_key(spark, how, count):
    """No cap on the rows of a key unless the query or a setting gives one."""
    e = Engine(spark).register("few", spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string"))
    e.register("many", spark.range(1500).selectExpr("1 k", "id y"), order_by=["k", "y"])
    text = f"select * from merge_by_key('k', few, many, 'full', '{how}')"
    got = e.sql(text).collect()
    assert len(got) == count
    if how == "array":
        assert [r.y for r in got[0].many] == list(range(1500)) and [r.x for r in got[0].few] == ["a", "b"]
    else:
        assert {r.y for r in got} == set(range(1500))
    with pytest.raises(Exception, match="over 1024 rows"):
        e.sql(text, **{"merge_by_key.maxRowsPerKey": 1024}).collect()


@pytest.mark.parametrize("first", ["constant", "outlier", "texts", "nulls"])
def test_numbers_and_elapsed_over_any_first_column(spark, first):
    """Ranges follow all order columns; no plan sends rows to a single partition."""
    make = {"constant": lambda i: "7", "outlier": lambda i: str(10**12 if i == 5 else i % 3), "texts": lambda i: f"t{i % 11}", "nulls": lambda i: None if i % 2 else f"{i % 5}"}[first]
    data = [(make(i), i * 7919 % 4001, i) for i in range(4000)]
    df = spark.createDataFrame(data, "a string, b long, c long").repartition(5)
    df = df.withColumn("a", F.col("a").cast("long")) if first in ("constant", "outlier") else df
    key = lambda r: (r.a is not None, r.a if r.a is not None else 0, r.b)
    numbered = rows.global_index(df, ["a", "b"], "i")
    got = sorted(numbered.collect(), key=lambda r: r.i)
    assert [r.i for r in got] == list(range(1, 4001)) and got == sorted(got, key=key)
    ranges = [r[0] for r in rows.in_ranges(df, ["a", "b"]).groupBy("__p").count().select("count").collect()]
    assert max(ranges) < 1200
    before = {r.c: r.w for r in rows.previous(df, ["a", "b"], F.col("c"), "w").collect()}
    assert [before[r.c] for r in got] == [None, *(r.c for r in got[:-1])]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and all("count" in line or "k0" in line or "__q" in line or "partial" in line for line in plan.split("\n") if "SinglePartition" in line and "__n" in line)


@pytest.mark.parametrize("name", ["tumbling_count", "combine_latest", "merge_order_desc", "property_paths", "row_index_elapsed", "sliding_count", "trace_in_group", "zip_two", "window_sort"])
def test_plans_do_not_grow_with_the_ranges(spark, name):
    """16 times the partitions, and so the ranges, must not make the plan larger: it is what the driver holds."""
    at, sizes = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            sizes.append(len(catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", at)
    assert sizes[1] < 1.1 * sizes[0]


def test_combine_over_ranges(spark):
    """Latest values pass from range to range, over a long stretch without a row of one source."""
    a = spark.createDataFrame([(i, f"a{i}") for i in range(0, 3000) if i < 50 or i > 2900], "ts long, x string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(20, 3000, 3)], "ts long, y string")
    got = [(r.__at if False else r["__at"], r.a.x, r.b.y) for r in sorted(merging.combine_latest({"a": (a, "ts"), "b": (b, "ts")}).collect(), key=lambda r: (r["__at"], r["__source"]))]
    want, la, lb = [], None, None
    for at, kind, v in sorted([(r.ts, 0, r.x) for r in a.collect()] + [(r.ts, 1, r.y) for r in b.collect()]):
        la, lb = (v, lb) if kind == 0 else (la, v)
        if la and lb:
            want.append((at, la, lb))
    assert got == want


def test_combine_orders_rows_of_one_time(spark, engine):
    """Rows of equal time follow the other columns of arrival, inside a range and from one to the next."""
    data = [(i, i // 40, "ab"[i % 2]) for i in range(800)]
    engine.register("same_time", spark.createDataFrame(data, "id long, ts long, kind string").orderBy(F.desc("id")), order_by=["ts", "id"])
    got = engine.sql("select a.id x, b.id y from combine((select ts, id from same_time where kind = 'a') a, (select ts, id from same_time where kind = 'b') b) c").collect()
    want, last = [], {}
    for i, _, kind in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        last[kind] = i
        if len(last) == 2:
            want.append((last["a"], last["b"]))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("text", ["delete from t", "select from t", "select nope(1)", "select x from t", "select this from missing", "select regexp_like('a', '(a+)+b')", "select time_bucket('0s', 1)", "select this from t limit -1", "select json_get('{}', '$..a')"])
def test_diagnostics(engine, text):
    with pytest.raises(QueryError):
        engine.sql(text)


def test_extensions(spark, engine):
    e = Engine(spark).register("t", sources.scalars(spark, [1, 2, 3]))
    e.scalar("twice", lambda x: f"({x} * 2)").aggregate("middle", F.median).table_function("upto", lambda n: spark.range(int(n)))
    e.expansion("upto", lambda x: f"sequence(1, {x})").grouping("parity", lambda df, keys, order, args, name: df.withColumn(name, F.col("t__this") % int(args[0])))
    e.distinct("by_parity", lambda df, columns, order: df.dropDuplicates(columns[:1]).where(f"`{columns[0]}` % 2 = 1"))
    e.property(lambda sql, kind, name: f"length({sql})" if name == "$chars" else None)
    assert sorted(r[0] for r in e.sql("select upto(this) n from t").collect()) == [1, 1, 1, 2, 2, 3]
    assert sorted(r[0] for r in e.sql("select count(1) c from t group by parity(2)").collect()) == [1, 2]
    assert sorted(r[0] for r in e.sql("/*+ distinctBy(by_parity) */ select distinct this from t").collect()) == [1, 3]
    with pytest.raises(QueryError):
        e.sql("/*+ distinctBy(other) */ select distinct this from t")
    e.register("named", spark.createDataFrame([("abc",)], "n string"))
    assert e.sql("select n.$chars c from named").first()[0] == 3
    assert e.sql("select middle(twice(this)) m from t").first()[0] == 4.0
    assert e.sql("select count(1) c from upto(7) x").first()[0] == 7
    assert [(c.alias, c.kind) for c in engine.select_columns("select name, v + 1 w from t1")] == [("name", "string"), ("w", "bigint")]


def test_merge_rejects_duplicates(spark, engine):
    engine.register("dup", spark.createDataFrame([(1, "x"), (1, "y")], "ts int, a string"))
    with pytest.raises(Exception, match="duplicate key"):
        engine.sql("select * from merge_by_key('ts', dup, f2)").collect()


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_catalogue_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    out = catalog.QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    want = con.sql(catalog.ORACLE[name])
    at = [want.columns.index(c) for c in cols]
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(show, r)) for r in out.select(*[f"`{c}`" for c in cols]).collect()) == sorted(tuple(show(r[i]) for i in at) for r in want.fetchall())


def test_collect_over_all_events(spark, tmp_path):
    """Neither query has SQL: lists in order of arrival, and maps to the last value, over a hot group, equal times, gaps and high ids."""
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=i * 7919 % 300), None if i % 13 == 0 else i % 17, "click" if i % 5 else f"t{i % 3}", None if i % 11 == 0 else float(i), "{}") for i in range(700)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    lists, maps = {}, {}
    for i, _, user, kind, value, _ in sorted(events, key=lambda e: e[1::-1]):
        lists.setdefault(kind, []).append({"event_id": i} | ({} if user is None else {"user_id": user}))
        if user is not None and value is not None:
            maps.setdefault(kind, {})[user] = value
    got = {r.event_type: json.loads(r.l) for r in catalog.QUERIES["collect_list_struct"](spark, str(tmp_path)).collect()}
    assert got == lists and sum(map(len, got.values())) == len(events)
    e = catalog.engine(spark, str(tmp_path))
    assert {r.event_type: r.m for r in e.sql("select event_type, collect_row(user_id, value) m from events group by event_type").collect()} == maps


def test_unique_avg_over_all_events(spark, tmp_path):
    """Users and values seen once have high ids; a hot user and a hot value are never among them."""
    events = [(i, 7 if i < 600 else i, 2.5 if i < 650 else i / 4) for i in range(700)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").selectExpr("*", "timestamp_seconds(event_id) ts").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    users, values = ([e[k] for e in events] for k in (1, 2))
    mean = lambda xs: sum(once := [x for x in xs if xs.count(x) == 1]) / len(once)
    got = catalog.QUERIES["agg_unique_avg"](spark, str(tmp_path)).collect()
    assert [(r.a, r.b, r.s) for r in got] == [(mean(users), mean(values), sum(set(users)))]


@pytest.mark.parametrize(("name", "key"), [("unnest_embedding", "vec_id"), ("lateral_unnest", "v")])
def test_unnest_of_all_embeddings(spark, tmp_path, name, key):
    """All vectors, high ids too; an empty or null list gives no rows."""
    vecs = [(i * 7, [float(i), float(k), 0.5] if k % 3 else [], k) for k, i in enumerate(range(90))] + [(10_000, None, 1)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label long").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r[key], r.x) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted((i, x) for i, v, _ in vecs for x in v or [])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = sources.stream(spark, "parquet", str(tmp_path / "in"), schema)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    timed = run(streaming.timed(stream, "ts", "1 day", [F.count("*").alias("c")]), "timed", "complete")
    assert timed.agg(F.sum("c")).first()[0] == 1000
    e = Engine(spark).register("s", stream, ["ts"], time="ts", late="1 day")
    by_text = e.sql("select to_millis(_window_start) w, event_type, count(1) c from s group by _window('1d'), event_type")
    assert run(by_text, "by_text", "complete").agg(F.sum("c")).first()[0] == 1000
    closed = run(streaming.count_or_timeout(stream, ["event_type"], "value", 50, 3_600_000), "closed")
    assert {r.n for r in closed.collect()} == {50}


class State:
    """What Spark hands to a state step, on a clock of the test."""

    def __init__(self):
        self.value, self.timeout, self.now, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.timeout = value, None

    def remove(self):
        self.value = self.timeout = None

    def setTimeoutDuration(self, ms):
        self.timeout = self.now + ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def test_count_or_timeout_keeps_its_timeout():
    """Each call has to set what is left of the timeout, as Spark forgets it; a window closes full, by timeout, or late."""
    step, state = windows.fold_or_timeout(["k"], ["k"], "v", 3, 1000), State()
    call = lambda *v: [tuple(r) for d in step(("a",), iter([pd.DataFrame({"v": list(v)})]), state) for r in d.itertuples(index=False)]
    assert call(1.0) == [] and state.timeout == 1000
    state.now = 400
    assert call(2.0) == [] and state.timeout == 1000
    state.now, state.hasTimedOut = 1000, True
    assert call() == [("a", 2, 3.0)] and not state.exists
    state.hasTimedOut = False
    state.now = 1500
    assert call(1.0, 1.0, 1.0, 5.0) == [("a", 3, 3.0)] and state.get == (1, 5.0, 1500) and state.timeout == 2500
    state.now = 2600
    assert call(7.0) == [("a", 1, 5.0)] and state.get == (1, 7.0, 2600) and state.timeout == 3600


def test_counted_keeps_types(spark, tmp_path):
    """Windows over several micro-batches: texts that look like numbers stay texts, whole numbers stay whole."""
    for k, ids in enumerate((["007", "1e5"], ["true", "2024-01-01"], ["x"])):
        spark.createDataFrame([("k", t, 2**60 + i) for i, t in enumerate(ids)], "k string, t string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sources.stream(spark, "parquet", str(tmp_path / "in"), "k string, t string, n long", maxFilesPerTrigger=1)
    close = lambda rows: pd.DataFrame({"first": [rows["t"].iloc[0]], "texts": [",".join(rows["t"])], "n": [int(rows["n"].sum() % 97)]})
    q = streaming.counted(stream, ["k"], "first string, texts string, n long", 3, close, ["t", "n"]).writeStream.format("memory").queryName("typed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("typed").collect()
    seen = {"007", "1e5", "true", "2024-01-01", "x"}
    assert len(got) == 1 and set(got[0].texts.split(",")) <= seen and got[0].first in seen


def test_combine_streams(spark, tmp_path):
    for k, (name, at) in enumerate((("a", 1), ("b", 2), ("a", 3))):
        spark.createDataFrame([("x", at)], "k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = {n: sources.stream(spark, "parquet", str(tmp_path / n), "k string, v long") for n in ("a", "b")}
    q = streaming.combine_latest(streams, "k").writeStream.format("memory").queryName("both").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(json.loads(r.a)["v"], json.loads(r.b)["v"]) for r in spark.table("both").collect()]
    assert got and all(a in (1, 3) and b == 2 for a, b in got)
