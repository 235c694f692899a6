"""Named queries over the driver's tables, with their oracle SQL.

Most are texts of the dialect; ``ORDER`` and ``TIME`` say how each table's rows arrive. Sums of doubles are rounded, as
their last digits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grouping, merging
from .session import Engine

ORDER = {
    "events": ["ts", "event_id"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "part": ["p_partkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "documents": ["doc_id"], "pages": ["page_id"], "labels": ["doc_id"], "embeddings": ["vec_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
TIME = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


class Tables(dict):
    """The tables of a folder, opened when a query names them."""

    def __init__(self, engine: Engine, sf_dir: str) -> None:
        super().__init__()
        self.engine, self.sf_dir = engine, sf_dir

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or name in ORDER

    def __missing__(self, name: str):
        from .plans.lowering import Result

        self[name] = Result(self.engine.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), ORDER[name], TIME.get(name))
        return self[name]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    e.tables = Tables(e, sf_dir)
    return e


def dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, text: str, oracle: str | None = None) -> None:
    """oracle: None if the text is plain SQL itself, '' if SQL can't express the query."""
    QUERIES[name] = dialect(text)
    if oracle != "":
        ORACLE[name] = text if oracle is None else oracle


# --- scans, projections, predicates --------------------------------------------------------------
add("group_having", "select event_type, count(1) total, round(avg(value), 6) avg_value from events where value > 100 group by event_type having total > 10",
    "select event_type, count(1) total, floor(avg(value) * 1e6 + 0.5) / 1e6 avg_value from events where value > 100 group by event_type having count(1) > 10")
add("scan_where_project", "select event_id, user_id, value * 2 twice from events where value > 50 and event_type = 'click'")
add("star_alias", "select n.*, r.r_name region_name from nation n left join region r on n.n_regionkey = r.r_regionkey")
add("predicate_mix", "select count(1) c from events where (value >= 10 and value < 90 or event_type in ('click', 'view')) and not (user_id = 7) and event_type != 'error'")
add("null_compare", "select count(1) c from (select event_id, case when event_type = 'error' then null else event_type end et from events) x where not (et = 'click')",
    "select count(1) c from events where event_type = 'error' or event_type <> 'click'")
add("not_in_compat", "select count(1) c from (select case when event_type = 'error' then null else event_type end et from events) x where et not in ('click', 'view')",
    "select count(1) c from events where event_type not in ('click', 'view')")
add("loose_compare", "select count(1) c from (select value l, '' r from events) x where l > r", "select cast(0 as bigint) c")
add("like_compat", "select c_custkey, c_name from customer where c_name like 'Customer%1' or c_mktsegment not like '%U%'")
add("between_compat", "select event_id from events where value between 20 and 30 or event_type between 'view' and 'signup'",
    "select event_id from events where value between 20 and 30 or event_type between 'signup' and 'view'")
add("is_predicates", "select count(1) c from (select case when value > 100 then true when value > 50 then false end f from events) x where f is not true or f is null",
    "select count(1) c from events where value <= 100")
add("truthiness", "select doc_id from labels where toxic and quality is not null", "select doc_id from labels where toxic = 1")
add("case_searched", "select event_id, case when value > 100 then 'high' when value > 50 then 'mid' else 'low' end band from events")
add("case_simple", "select event_id, case event_type when 'click' then 1 when 'view' then 2 else 0 end code from events",
    "select event_id, cast(case event_type when 'click' then 1 when 'view' then 2 else 0 end as bigint) code from events")
add("property_paths", "select event_id, cast(props.k as int) k, row.index i from events", "select event_id, cast(json_extract_string(props, '$.k') as int) k, row_number() over (order by ts, event_id) i from events")
add("array_index", "select vec_id, embedding[0] a, embedding.size n from embeddings", "select vec_id, embedding[1] a, cast(len(embedding) as bigint) n from embeddings")
add("row_index_elapsed", "select event_id, row.index i, row.elapsed ms from events",
    "select event_id, row_number() over (order by ts, event_id) i, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (order by ts, event_id) ms from events")
# --- distinct, sort, limit, set operations ---------------------------------------------------------
add("distinct_input_row", "select distinct u from (select user_id u, event_type t from events) x", "select u from (select distinct user_id u, event_type t from events)")
add("star_with_items", "select n_nationkey * 2 twice, * from nation", "select n_nationkey * 2 twice, * from nation")
add("scalar_subquery_item", "select k, x.c c from (select n.n_nationkey k, (select count(1) c from supplier s where s.s_nationkey = n.n_nationkey) x from nation n) z",
    "select n_nationkey k, (select count(1) from supplier where s_nationkey = n_nationkey) c from nation")
add("with_names", "with big as (select o_custkey k, o_totalprice p from orders where o_totalprice > 1000), per(k, n) as (select k, count(1) c from big group by k) select c.c_name name, per.n n from per join customer c on c.c_custkey = per.k",
    "with big as (select o_custkey k from orders where o_totalprice > 1000), per as (select k, count(1) n from big group by k) select c_name name, n from per join customer on c_custkey = k")
add("no_from", "select 1 + 1 two, upper('a') a", "select cast(2 as bigint) two, 'A' a")
add("distinct_on", "select distinct on (user_id) user_id, event_id from events",
    "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) where rn = 1")
add("order_nulls", "select event_id, case when event_type = 'error' then null else value end v from events order by v desc nulls last, event_id limit 40",
    "select event_id, case when event_type = 'error' then null else value end v from events order by v desc nulls last, event_id limit 40")
add("topn_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5, 20", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5")
add("union", "select v from (select n_nationkey v from nation union select r_regionkey v from region) x", "select n_nationkey v from nation union select r_regionkey from region")
add("union_all", "select v from (select n_nationkey v from nation union all select r_regionkey v from region) x", "select n_nationkey v from nation union all select r_regionkey from region")
add("minus", "select v from (select s_nationkey v from supplier minus select r_regionkey v from region) x", "select s_nationkey v from supplier except select r_regionkey from region")
add("except_compat", "select v from (select r_regionkey v from region except select n_nationkey v from nation) x", "select n_nationkey v from nation except select r_regionkey from region")
add("intersect", "select v from (select s_nationkey v from supplier intersect select c_nationkey v from customer) x", "select s_nationkey v from supplier intersect select c_nationkey from customer")
add("values_source", "select sum(t.a + t.b) s from (values (1,2,3),(1,2,3)) t(a,b,c)", "select cast(6 as double) s")
# --- joins and sub-queries -------------------------------------------------------------------------
add("join_inner", "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where o.o_totalprice > 1000", "select o_orderkey \"o.o_orderkey\", c_name \"c.c_name\" from orders join customer on o_custkey = c_custkey where o_totalprice > 1000")
add("join_comma", "select count(1) c from supplier s, nation n where s.s_nationkey = n.n_nationkey and n.n_regionkey = 1", "select count(1) c from supplier, nation where s_nationkey = n_nationkey and n_regionkey = 1")
add("join_left", "select c.c_custkey k, count(o.o_orderkey) n from customer c left join orders o on c.c_custkey = o.o_custkey group by c.c_custkey",
    "select c_custkey k, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey group by c_custkey")
add("join_right_compat", "select n.n_nationkey nk, r.r_regionkey rk from nation n right join region r on n.n_regionkey = r.r_regionkey",
    "select case when n_regionkey = r_regionkey then n_nationkey end nk, r_regionkey rk from nation, region")
add("join_right_ansi", "/*+ mode(ansi) */ select n.n_nationkey nk, r.r_regionkey rk from nation n right join region r on n.n_regionkey = r.r_regionkey and n.n_nationkey > 12",
    "select n_nationkey nk, r_regionkey rk from nation right join region on n_regionkey = r_regionkey and n_nationkey > 12")
add("join_cross", "select count(1) c from nation cross join region")
add("join_theta", "select s.s_suppkey k, count(1) c from supplier s join nation n on s.s_nationkey < n.n_nationkey group by s.s_suppkey",
    "select s_suppkey k, count(1) c from supplier join nation on s_nationkey < n_nationkey group by s_suppkey")
add("join_using", "/*+ mode(ansi) */ select k, x.a a, y.b b from (select n_regionkey k, n_nationkey a from nation where n_regionkey > 0) x full join (select r_regionkey k, r_name b from region where r_regionkey < 4) y using (k)",
    "select k, a, b from (select n_regionkey k, n_nationkey a from nation where n_regionkey > 0) full join (select r_regionkey k, r_name b from region where r_regionkey < 4) using (k)")
add("join_semi_anti", "/*+ mode(ansi) */ select c_custkey k from (select c.c_custkey c_custkey from customer c left semi join orders o on o.o_custkey = c.c_custkey) x left anti join supplier s on s.s_suppkey = x.c_custkey",
    "select c_custkey k from customer where c_custkey in (select o_custkey from orders) and c_custkey not in (select s_suppkey from supplier)")
add("join_paren_from", "select x.n_name a from (nation) x join (region) r on x.n_regionkey = r.r_regionkey where r.r_name like 'A%'", "select n_name a from nation join region on n_regionkey = r_regionkey where r_name like 'A%'")
add("set_op_top", "select n_regionkey k from nation minus select r_regionkey k from region where r_regionkey > 1", "select n_regionkey k from nation except select r_regionkey from region where r_regionkey > 1")
add("join_lateral", "select n.n_nationkey nk, x.k from nation n left join (select s.s_suppkey k from supplier s where s.s_nationkey = n.n_nationkey and s.s_acctbal > 0) x",
    "select n_nationkey nk, s_suppkey \"x.k\" from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 0")
add("exists", "select c_custkey from customer where exists (select 1 from orders o where o.o_custkey = customer.c_custkey and o.o_totalprice > 1000)",
    "select c_custkey from customer where exists (select 1 from orders o where o.o_custkey = c_custkey and o.o_totalprice > 1000)")
add("not_exists", "select c_custkey from customer where not exists (select 1 from orders o where o.o_custkey = customer.c_custkey)",
    "select c_custkey from customer where not exists (select 1 from orders o where o.o_custkey = c_custkey)")
add("in_subquery", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
add("not_in_subquery", "select c_custkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 2)")
add("scalar_subquery", "select count(1) c from orders where o_totalprice > (select avg(o_totalprice) a from orders)", "select count(1) c from orders where o_totalprice > (select avg(o_totalprice) a from orders)")
# --- grouping and aggregates -----------------------------------------------------------------------
add("group_two_keys", "select o_orderstatus, o_orderpriority, count(1) c, max(o_totalprice) hi, min(o_totalprice) lo from orders group by o_orderstatus, o_orderpriority")
add("group_expr_int_div", "select count(1) c, min(event_id / 100) b from events group by event_id / 100", "select count(1) c, event_id // 100 b from events group by event_id // 100")
add("group_by_function", "select date_format(o_orderdate, 'yyyy-MM') m, count(1) c from orders group by date_format(o_orderdate, 'yyyy-MM')", "select strftime(o_orderdate, '%Y-%m') m, count(1) c from orders group by 1")
add("group_null_key", "select count(1) c from (select case when event_type = 'error' then null else event_type end et from events) x group by et",
    "select count(1) c, event_type et from events where event_type <> 'error' group by event_type")
add("group_key_list", "select count(1) c, _group_by_key[0] k from events group by event_type", "select count(1) c, event_type k, event_type from events group by event_type")
add("agg_distinct_count", "select event_type, count(distinct user_id) d, distinct_count(user_id) e from events group by event_type", "select event_type, count(distinct user_id) d, count(distinct user_id) e from events group by event_type")
add("agg_unique_count", "select event_type, count(unique user_id) u from events group by event_type",
    "select event_type, cast(count(*) filter (where n = 1) as bigint) u from (select event_type, user_id, count(*) n from events group by all) group by event_type")
add("agg_unique_avg", "select avg(unique user_id) a, round(avg(unique value), 6) b, sum(distinct user_id) s from events",
    "select a, floor(b * 1e6 + 0.5) / 1e6 b, s from (select avg(user_id) filter (where n = 1) a, cast(sum(user_id) as double) s from (select user_id, count(*) n from events group by all)), (select avg(value) filter (where n = 1) b from (select value, count(*) n from events group by all))")
add("agg_sum_double", "select sum(l_linenumber) s, count(*) c, count(l_partkey) p from lineitem", "select cast(sum(l_linenumber) as double) s, count(*) c, count(l_partkey) p from lineitem")
add("pricing_summary", "select l_returnflag, l_linestatus, sum(l_quantity) q, round(sum(l_extendedprice * (1 - l_discount)), 0) rev, count(1) c from lineitem where l_shipdate <= {ts '1998-09-02 00:00:00'} group by l_returnflag, l_linestatus",
    "select l_returnflag, l_linestatus, sum(l_quantity) q, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) rev, count(1) c from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
add("last_row_per_group", "select user_id, event_id, value from events group by user_id", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
add("mixed_items", "select event_type, count(1) c, event_id last_id from events group by event_type", "select event_type, count(1) c, arg_max(event_id, (ts, event_id)) last_id from events group by event_type")
add("take_first_n", "select take(event_id, 2) e from events group by user_id", "select event_id e, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) where rn <= 2")
add("take_last_n", "select take(event_id, -2) e from events group by user_id", "select event_id e, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 2")
add("take_first_then_last", "select take(event_id, 3, -2) e from events group by user_id",
    "select event_id e, user_id from (select *, row_number() over (partition by user_id order by rn desc) r2 from (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) where rn <= 3) where r2 <= 2")
add("group_take", "select event_id, user_id from events group by user_id, take(1)", "select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) where rn = 1")
add("collect_list_size", "select event_type, array_len(collect_list(event_id)) n from events group by event_type", "select event_type, count(1) n from events group by event_type")
add("collect_list_struct", "select event_type, to_json(collect_list(event_id, user_id)) l from events group by event_type",
    "select event_type, cast(to_json(list({'event_id': event_id, 'user_id': user_id} order by ts, event_id)) as varchar) l from events group by event_type")
add("collect_row_map", "select event_type, m.size n, math.max(m.values) hi, round(math.avg(m.values), 6) mean from (select event_type, collect_row(user_id, event_id) m from events group by event_type) x",
    "select event_type, count(1) n, max(e)::double hi, floor(avg(e) * 1e6 + 0.5) / 1e6 mean from (select event_type, user_id, arg_max(event_id, (ts, event_id)) e from events group by all) group by event_type")
add("collect_all_rows", "select o_orderstatus, array_len(l) n, l[0].o_orderkey first_key, l[2].o_custkey third from (select o_orderstatus, collect_list() l from orders group by o_orderstatus) x",
    "select o_orderstatus, count(1) n, min(o_orderkey) first_key, min(o_custkey) filter (where rn = 3) third from (select *, row_number() over (partition by o_orderstatus order by o_orderkey) rn from orders) group by 1")
add("collect_sub_select", "select event_type, to_json(collect_list((select event_id e, value * 2 v from events where value > 150))) l from events group by event_type",
    "select event_type, coalesce('[' || string_agg('{\"e\":' || event_id || ',\"v\":' || cast(value * 2 as varchar) || '}', ',' order by ts, event_id) filter (where value > 150) || ']', '[]') l from events group by event_type")
add("collect_modifiers", "select event_type, array_len(collect_list(distinct user_id)) d, array_len(collect_list(unique user_id)) u from events group by event_type",
    "select event_type, count(1) d, count(1) filter (where n = 1) u from (select event_type, user_id, count(1) n from events group by all) group by 1")
add("agg_modifiers", "select event_type, sum(unique user_id) su, max(unique user_id) hi, min(distinct user_id) lo, avg(distinct user_id) ad from events group by event_type",
    "select event_type, cast(sum(user_id) filter (where n = 1) as double) su, max(user_id) filter (where n = 1) hi, min(user_id) lo, avg(user_id) ad from (select event_type, user_id, count(1) n from events group by all) group by 1")
add("take_distinct", "select take(distinct event_type, 2) t from events group by user_id",
    "select event_type t, user_id from (select *, row_number() over (partition by user_id order by o) rn from (select user_id, event_type, min((ts, event_id)) o from events group by all)) where rn <= 2")
add("take_unique", "select take(unique event_type) t from events group by user_id",
    "select event_type t, user_id from (select *, row_number() over (partition by user_id order by o) rn from (select user_id, event_type, min((ts, event_id)) o from events group by all having count(1) = 1)) where rn = 1")
# --- windows ---------------------------------------------------------------------------------------
add("tumbling_time", "select to_millis(_window_start) w, count(1) c from events group by _window('6h')", "select epoch_ms(time_bucket(interval '6 hours', ts, timestamp '1970-01-01')) w, count(1) c from events group by 1")
add("interval_by_key", "select to_millis(_window_start) w, event_type, count(1) c from events group by interval('1d'), event_type", "select epoch_ms(date_trunc('day', ts)) w, event_type, count(1) c from events group by 1, 2")
add("sliding_time", "select to_millis(_window_start) w, count(1) c from events group by _window('1d', '12h')",
    "select epoch_ms(w) w, count(1) c from (select time_bucket(interval '12 hours', ts, timestamp '1970-01-01') - k * interval '12 hours' w from events, range(2) r(k)) group by 1")
add("tumbling_count", "select _window_start w, count(1) c, sum(event_id) s from events group by _window(64)",
    "select w, count(1) c, cast(sum(event_id) as double) s from (select event_id, (row_number() over (order by ts, event_id) - 1) // 64 w from events) group by w")
add("sliding_count", "select _window_start w, sum(event_id) s from events group by _window(30, 10)",
    "select w, cast(sum(event_id) as double) s from (select event_id, unnest(range(greatest(0, cast(ceil((i - 29) / 10) as bigint)), i // 10 + 1)) w from (select event_id, row_number() over (order by ts, event_id) - 1 i from events)) group by w")
add("count_window_by_key", "select event_type, _window_start w, count(1) c from events group by event_type, _window(50)",
    "select event_type, w, count(1) c from (select event_type, (row_number() over (partition by event_type order by ts, event_id) - 1) // 50 w from events) group by all")
add("count_or_timeout", "select user_id, _window_start w, count(1) c from events group by user_id, _window(5, '2d')",
    "with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) i from events), n as (select a.user_id, a.i, coalesce(min(b.i), a.i + 5) nxt from e a left join e b on a.user_id = b.user_id and b.i > a.i and b.i <= a.i + 5 and (b.ts >= a.ts + interval '2 days' or b.i = a.i + 5) group by a.user_id, a.i), w as (select user_id, i, nxt, 0::bigint w from n where i = 1 union all select n.user_id, n.i, n.nxt, w.w + 1 from w join n on n.user_id = w.user_id and n.i = w.nxt) select w.user_id, w, count(1) c from w join e on e.user_id = w.user_id and e.i >= w.i and e.i < w.nxt group by w.user_id, w")
add("trace_in_group", "select event_id, row.index i from events group by _window(50), trace(), take(3)",
    "select arg_max(event_id, rn) event_id, max(rn % 50) + 1 i from (select event_id, row_number() over (order by ts, event_id) - 1 rn from events) where rn % 50 < 3 group by rn // 50")
add("interval_empty", "/*+ interval.empty(true) */ select to_millis(_window_start) w, count(1) c from events group by interval('10m')",
    "with b as (select time_bucket(interval '10 minutes', ts, timestamp '1970-01-01') w, count(1) c from events group by 1) select epoch_ms(s.w) w, coalesce(c, 0) c from (select unnest(generate_series((select min(w) from b), (select max(w) from b), interval '10 minutes')) w) s left join b using (w)")
# --- several sources -------------------------------------------------------------------------------
add("zip_two", "select a.event_id x, b.o_orderkey y from zip((select event_id, ts from events) a, (select o_orderkey from orders) b) z",
    "select event_id x, o_orderkey y from (select event_id, row_number() over (order by event_id) i from events) join (select o_orderkey, row_number() over (order by o_orderkey) i from orders) using (i)")
add("combine_latest", "select a.event_id x, b.event_id y from combine((select event_id, ts from events where event_type = 'click') a, (select event_id, ts from events where event_type = 'view') b) c",
    "select x, y from (select last_value(x ignore nulls) over w x, last_value(y ignore nulls) over w y from (select ts, 0 s, event_id x, null y from events where event_type = 'click' union all select ts, 1, null, event_id from events where event_type = 'view') window w as (order by ts, s rows between unbounded preceding and current row)) where x is not null and y is not null")
_A, _B = "(select o_custkey k, count(1) a from orders where o_orderstatus = 'F' group by o_custkey) x", "(select c_custkey k, c_acctbal b from customer where c_acctbal > 0) y"
_SA, _SB = "(select o_custkey k, count(1) a from orders where o_orderstatus = 'F' group by o_custkey)", "(select c_custkey k, c_acctbal b from customer where c_acctbal > 0)"
for _mode, _how in (("full", "full"), ("inner", "inner"), ("left", "left"), ("right", "right")):
    add(f"merge_{_mode}", f"select k, a, b from merge_by_key('k', (select k, a from {_A}) x, (select k, b from {_B}) y, '{_mode}')", f"select k, a, b from {_SA} {_how} join {_SB} using (k)")
add("merge_order_desc", "select row.index i, k, a from merge_by_key('k', (select o_orderkey k, o_totalprice a from orders) x, (select l_orderkey k, count(1) n from lineitem group by l_orderkey) y, 'left', 'desc') m",
    "select row_number() over (order by o_orderkey desc) i, o_orderkey k, o_totalprice a from orders")
add("merge_dup_zip", "select k, a, b from merge_by_key('k', (select n_regionkey k, n_nationkey a from nation order by k, a) x, (select s_nationkey k, s_suppkey b from supplier order by k, b) y, 'full', 'zip')",
    "select k, a, b from (select n_regionkey k, n_nationkey a, row_number() over (partition by n_regionkey order by n_nationkey) r from nation) full join (select s_nationkey k, s_suppkey b, row_number() over (partition by s_nationkey order by s_suppkey) r from supplier) using (k, r)")
add("merge_dup_cartesian", "select k, a, b from merge_by_key('k', (select n_regionkey k, n_nationkey a from nation order by k, a) x, (select s_nationkey k, s_suppkey b from supplier order by k, b) y, 'inner', 'cartesian')",
    "select n_regionkey k, n_nationkey a, s_suppkey b from nation join supplier on n_regionkey = s_nationkey")
add("merge_dup_array", "select k, array_len(x) nx, array_len(y) ny from merge_by_key('k', (select n_regionkey k, n_nationkey a from nation order by k, a) x, (select s_nationkey k, s_suppkey b from supplier order by k, b) y, 'full', 'array')",
    "select k, coalesce(nx, 0) nx, coalesce(ny, 0) ny from (select n_regionkey k, count(1) nx from nation group by 1) full join (select s_nationkey k, count(1) ny from supplier group by 1) using (k)")
add("unnest_embedding", "select vec_id, unnest(embedding) x from embeddings")
add("unnest_multi", "select u.c c, u.d d from unnest(array[1, 2, 3], array['x', 'y']) as u(c, d)", "select unnest([1, 2, 3])::bigint c, unnest(['x', 'y', null]) d")
add("lateral_unnest", "select e.vec_id v, u.x x from embeddings e cross join unnest(e.embedding) as u(x)", "select vec_id v, unnest(embedding) x from embeddings")
# --- functions -------------------------------------------------------------------------------------
add("math_functions", "select event_id, round(math.log(value + 1), 6) a, floor(value) b, ceil(value) c, round(value) d, round(pow(value, 2), 3) e, math.max(value, 50, event_id) f, greatest(value, 10.5) g, value % 7 h from events",
    "select event_id, floor(ln(value + 1) * 1e6 + 0.5) / 1e6 a, floor(value) b, ceil(value) c, cast(floor(value + 0.5) as bigint) d, floor(value * value * 1e3 + 0.5) / 1e3 e, greatest(value, 50.0, event_id)::double f, greatest(value, 10.5::double) g, value % 7 h from events")
add("int_arithmetic", "select event_id / 7 q, event_id % 7 r, event_id * 3 - 1 t, 7.0 / 2 x from events", "select event_id // 7 q, event_id % 7 r, event_id * 3 - 1 t, 3.5::double x from events")
add("bit_functions", "select event_id & 12 a, event_id | 3 b, event_id ^ 5 c, event_id << 2 d, event_id >> 1 e, ~event_id f, bit_count(event_id) g from events",
    "select event_id & 12 a, event_id | 3 b, xor(event_id, 5) c, event_id << 2 d, event_id >> 1 e, ~event_id f, cast(bit_count(event_id) as bigint) g from events")
add("string_functions", "select p_partkey, upper(p_name) a, length(p_name) b, concat(p_brand, null, '-', p_type) c, concat_ws('/', p_brand, p_type) d, left(p_name, 3) e, right(p_name, 2) f, lpad(p_brand, 12, '*') g, reverse(p_type) h, strpos(p_name, 'a') i, replace(p_name, 'a', 'b') j, contains(p_name, 'e') k from part",
    "select p_partkey, upper(p_name) a, length(p_name) b, p_brand || '-' || p_type c, p_brand || '/' || p_type d, left(p_name, 3) e, right(p_name, 2) f, lpad(p_brand, 12, '*') g, reverse(p_type) h, instr(p_name, 'a') i, replace(p_name, 'a', 'b') j, contains(p_name, 'e') k from part")
add("substr_zero_based", "select c_custkey, substr(c_name, 2) a, substr(c_name, -3) b, substring(c_name, 2, 3) c, substring(c_name, 0) d, substr(c_name, 1, 2) e from customer",
    "select c_custkey, c_name[3:] a, right(c_name, 3) b, c_name[2:4] c, '' d, c_name[2:3] e from customer")
add("split_part_edges", "select page_id, split_part(url, '/', 3) host, split_part(url, '/', -1) last, split_part(url, '/', 0) zero, split_part(url, '/', 99) none from pages",
    "select page_id, split_part(url, '/', 3) host, split_part(url, '/', -1) last, '' zero, '' none from pages")
add("regex_functions", "select page_id, regexp_extract(url, 'http://([a-z]+)') a, regexp_replace(url, '[0-9]+', '#') b, regexp_like(url, 'EXAMPLE', 'i') c, regexp_extract(url, 'zzz') d from pages",
    "select page_id, nullif(regexp_extract(url, 'http://([a-z]+)', 1), '') a, regexp_replace(url, '[0-9]+', '#', 'g') b, regexp_matches(url, '(?i)EXAMPLE') c, null::varchar d from pages")
add("date_functions", "select o_orderkey, year(o_orderdate) y, month(o_orderdate) m, day_of_week(o_orderdate) w, day_of_year(o_orderdate) d, date_format(o_orderdate, 'yyyy/MM/dd') f, unix_timestamp(o_orderdate) u, date_part('quarter', o_orderdate) q, to_iso_instant(o_orderdate) i from orders",
    "select o_orderkey, cast(year(o_orderdate) as int) y, cast(month(o_orderdate) as int) m, cast(isodow(o_orderdate) as int) w, cast(dayofyear(o_orderdate) as int) d, strftime(o_orderdate, '%Y/%m/%d') f, cast(epoch(o_orderdate) as bigint) u, quarter(o_orderdate) q, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') i from orders")
add("date_trunc_units", "select event_id, to_millis(date_trunc('hour', ts)) h, to_millis(date_trunc('week', ts)) w, to_millis(time_bucket('15 minutes', ts)) b from events",
    "select event_id, epoch_ms(date_trunc('hour', ts)) h, epoch_ms(date_trunc('week', ts)) w, epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % 900000 b from events")
add("datediff_periods", "select event_id, datediff(ts, '2024-01-01 12:00:00') d, date_diff(ts, '2024-01-01', 'hour') h, to_millis(date_add(ts, 2, 'month')) m from events",
    "select event_id, datesub('day', timestamp '2024-01-01 12:00:00', ts) d, datesub('hour', timestamp '2024-01-01', ts) h, epoch_us(ts + interval '2 months') // 1000 m from events")
add("cast_matrix", "select event_id, cast(value as int) i, cast(value as string) s, cast('100.2' as long) l, '7'::int p, cast('yes' as bool) b, cast(event_id as bool) o from events",
    "select event_id, cast(trunc(value) as int) i, cast(value as varchar) s, 100::bigint l, 7 p, true b, event_id = 1 o from events")
add("conditional_functions", "select event_id, if(value > 100, 'a', 'b') i, coalesce(null, event_type) c, choose(2, 'x', event_type) ch, all_match(true, value > 10) am, any_match(value > 190, event_id = 1) an from events",
    "select event_id, case when value > 100 then 'a' else 'b' end i, event_type c, event_type ch, value > 10 am, value > 190 or event_id = 1 an from events")
add("array_functions", "select vec_id, array_len(embedding) n, contains_all(array[1, 2, 3], label) a, contains_any(array[0, 5], label) b, not_contains(array[0, 5], label) c, in(label, 1, 2) d from embeddings",
    "select vec_id, cast(len(embedding) as bigint) n, label in (1, 2, 3) a, label in (0, 5) b, label not in (0, 5) c, label in (1, 2) d from embeddings")
add("map_functions", "select m.event_id e, m.mp.size n, m.mp.a a from (select event_id, new_map('a', value, 'b', 2.0) mp from events) m",
    "select event_id e, 2::bigint n, value a from events")
add("json_get", "select event_id, cast(json_get(props, '$.k') as long) k, json_get(props, '$.zz', 'none') d, json_exists(props, '$.k') e from events",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) k, 'none' d, true e from events")
add("json_operators", "select event_id, props->>'k' a, props#>>'{k}' b from events", "select event_id, props->>'k' a, props->>'k' b from events")
add("json_length_keys_type", "select event_id, json_length(props) n, json_keys(props)[0] k, json_type(props) t, json_valid(props) v, json_depth(props) d from events",
    "select event_id, 1::bigint n, 'k' k, 'OBJECT' t, true v, 2::bigint d from events")
add("json_contains", "select event_id, json_contains(props, '{}') a, json_equal(props, '{\"k\": -1}') b, json_overlaps('[1, 2]', '[2.0]') c from events", "select event_id, true a, false b, true c from events")
add("json_merge_patch", "select event_id, json_merge_patch(props, '{\"k\": null, \"n\": 1}') a, json_merge('[1]', '[2]') b from events", "select event_id, '{\"n\":1}' a, '[1,2]' b from events")
add("json_set_ops", "select event_id, json_intersect('[1,2,3]', '[3,1]') a, json_union('[1,2]', '[2,4]') b, json_diff('[1,2,2]', '[1]') c from events", "select event_id, '[1,3]' a, '[1,2,4]' b, '[2,2]' c from events")


# --- functions over varied values --------------------------------------------------------------------
add("trigonometry", "select event_id, round(math.sin(value), 6) a, round(math.cos(value), 6) b, round(math.tan(value / 200), 6) c, round(math.asin(value / 1000), 6) d, round(math.acos(value / 1000), 6) e, round(math.atan(value), 6) f, round(math.atan2(value, event_id), 6) g, round(math.degrees(value / 9), 4) h, round(math.radians(value), 6) i from events",
    "select event_id, floor(sin(value) * 1e6 + 0.5) / 1e6 a, floor(cos(value) * 1e6 + 0.5) / 1e6 b, floor(tan(value / 200) * 1e6 + 0.5) / 1e6 c, floor(asin(value / 1000) * 1e6 + 0.5) / 1e6 d, floor(acos(value / 1000) * 1e6 + 0.5) / 1e6 e, floor(atan(value) * 1e6 + 0.5) / 1e6 f, floor(atan2(value, event_id) * 1e6 + 0.5) / 1e6 g, floor(degrees(value / 9) * 1e4 + 0.5) / 1e4 h, floor(radians(value) * 1e6 + 0.5) / 1e6 i from events")
add("hyperbolic", "select event_id, round(math.sinh(value / 100), 6) a, round(math.cosh(value / 100), 6) b, round(math.tanh(value / 100), 6) c, round(math.exp(value / 100), 6) d, round(math.expm1(value / 100), 6) e, round(math.log1p(value), 6) f, round(math.log10(value + 1), 6) g, math.rint(value) h, math.sqrt(event_id) i, abs(50 - event_id) j, math.copy_sign(value, 50 - event_id) k, round(math.ieee_rem(value, 7), 6) l from events",
    "select event_id, floor(sinh(value / 100) * 1e6 + 0.5) / 1e6 a, floor(cosh(value / 100) * 1e6 + 0.5) / 1e6 b, floor(tanh(value / 100) * 1e6 + 0.5) / 1e6 c, floor(exp(value / 100) * 1e6 + 0.5) / 1e6 d, floor((exp(value / 100) - 1) * 1e6 + 0.5) / 1e6 e, floor(ln(value + 1) * 1e6 + 0.5) / 1e6 f, floor(log10(value + 1) * 1e6 + 0.5) / 1e6 g, round_even(value, 0) h, sqrt(event_id) i, abs(50.0::double - event_id) j, case when event_id > 50 then -value else value end k, floor((value - 7 * round_even(value / 7, 0)) * 1e6 + 0.5) / 1e6 l from events")
add("math_lists", "select event_id, math.min(value, 50, event_id) a, math.avg(value, event_id) b, math.count(value, null, event_id) c, least(event_id, 30) d, math.plus(event_id, 2) e, math.sub(event_id, 2) f, math.mul(event_id, 2) g, math.divi(event_id, 2) h, math.mod(event_id, 5) i from events",
    "select event_id, least(value, 50.0, event_id)::double a, (value + event_id) / 2 b, 2::bigint c, least(event_id, 30) d, event_id + 2 e, event_id - 2 f, event_id * 2 g, event_id // 2 h, event_id % 5 i from events")
add("shifts_and_words", "select event_id, (0 - event_id) >>> 60 a, bit_left_shift(event_id, 3) b, bit_right_shift(event_id, 1) c, bit_unsigned_shift(event_id, 2) d, bit_not(event_id) e, bit_and(event_id, 6) f, bit_or(event_id, 6) g, bit_mutex(event_id, 6) h from events",
    "select event_id, case when event_id > 0 then 15 else 0 end::bigint a, event_id << 3 b, event_id >> 1 c, event_id >> 2 d, ~event_id e, event_id & 6 f, event_id | 6 g, xor(event_id, 6) h from events")
add("compare_functions", "select event_id, eq(user_id, '7') a, neq(user_id, 7) b, gt(value, '100') c, gte(value, 100) d, lt(value, 100) e, lte(value, event_id) f, str_like(event_type, 'c%') g, str_nlike(event_type, 'c%') h from events",
    "select event_id, user_id = 7 a, user_id <> 7 b, value > 100 c, value >= 100 d, value < 100 e, value <= event_id f, event_type like 'c%' g, event_type not like 'c%' h from events")
add("range_functions", "select event_id from events where btw(value, 20, 40) or range(user_id, array[3, 5]) or nin(event_type, 'click', 'view') and nbtw(value, 10, 190)",
    "select event_id from events where value between 20 and 40 or user_id between 3 and 5 or event_type not in ('click', 'view') and value not between 10 and 190")
add("case_predicates", "select event_id from events where case when event_type = 'click' then value > 100 else value < 20 end",
    "select event_id from events where case when event_type = 'click' then value > 100 else value < 20 end")
add("case_times", "select o_orderkey, case when o_orderdate < {d '1995-01-01'} then 'old' when o_orderdate < {ts '1997-06-01 00:00:00'} then 'mid' else 'new' end age from orders",
    "select o_orderkey, case when o_orderdate < date '1995-01-01' then 'old' when o_orderdate < timestamp '1997-06-01' then 'mid' else 'new' end age from orders")
add("string_trims", "select c_custkey, trim(concat('  ', c_name, ' ')) a, ltrim(concat('  ', c_name)) b, rtrim(concat(c_name, '  ')) c, repeat(left(c_mktsegment, 2), 3) d, c_name || '/' || c_custkey e, rpad(c_mktsegment, 4, '-') f from customer",
    "select c_custkey, c_name a, c_name b, c_name c, repeat(left(c_mktsegment, 2), 3) d, c_name || '/' || c_custkey e, rpad(c_mktsegment, 4, '-') f from customer")
add("string_search", "select p_partkey, starts_with(p_name, 'a') a, ends_with(p_type, 'L') b, locate('a', p_name) c, locate('a', p_name, 4) d, position(p_name, 'e') e, lower(p_brand) f, char_length(p_type) g from part",
    "select p_partkey, starts_with(p_name, 'a') a, ends_with(p_type, 'L') b, instr(p_name, 'a') c, case when instr(substr(p_name, 4), 'a') > 0 then instr(substr(p_name, 4), 'a') + 3 else 0 end d, instr(p_name, 'e') e, lower(p_brand) f, length(p_type) g from part")
add("times_from_numbers", "select event_id, to_unixtime(ts) a, to_millis(from_unixtime(event_id * 1000)) b, from_unixtime(event_id, 'yyyy-MM-dd HH:mm:ss') c, unix_timestamp(ts) d, to_millis(cast(event_id * 1000 as timestamp)) e from events",
    "select event_id, (epoch_us(ts) // 1000) / 1000.0::double a, event_id * 1000000 b, strftime(timestamp '1970-01-01' + to_seconds(event_id), '%Y-%m-%d %H:%M:%S') c, cast(floor(epoch(ts)) as bigint) d, event_id * 1000 e from events")
add("date_units", "select event_id, hour(ts) h, minute(ts) mi, second(ts) s, day_of_month(ts) d, to_millis(date_trunc('month', ts)) m, to_millis(date_trunc('year', ts)) y, to_millis(date_trunc('minute', ts)) n, to_millis(date_trunc('day', ts)) t, to_millis(date_sub(ts, 3, 'week')) w, to_millis(date_add(ts, 90, 'second')) a from events",
    "select event_id, hour(ts)::int h, minute(ts)::int mi, second(ts)::int s, day(ts)::int d, epoch_ms(date_trunc('month', ts)) m, epoch_ms(date_trunc('year', ts)) y, epoch_ms(date_trunc('minute', ts)) n, epoch_ms(date_trunc('day', ts)) t, epoch_us(ts - interval '3 weeks') // 1000 w, epoch_us(ts + interval '90 seconds') // 1000 a from events")
add("date_parts", "select event_id, date_part('year', ts) y, date_part('month', ts) m, date_part('week', ts) w, date_part('day', ts) d, date_part('hour', ts) h, date_part('dow', ts) wd, date_part('doy', ts) dy, date_part('epoch', ts) e, date_part('millisecond', ts) ms from events",
    "select event_id, year(ts) y, month(ts) m, week(ts) w, day(ts) d, hour(ts) h, isodow(ts) wd, dayofyear(ts) dy, cast(floor(epoch(ts)) as bigint) e, epoch_us(ts) // 1000 % 1000 ms from events")
add("json_paths", "select event_id, json_extract(props, '$.k') a, json_value(props, '$.k') b, json_query(d, '$.l') c, json_extract_path(d, 'o', 'x') e, json_extract_path_text(d, 'o', 'x') f, json_get(d, p) g, d->'l'->>1 h, d#>'{o,x}' i from (select event_id, props, concat('{\"l\":', json_array(event_id, user_id), ',\"o\":', json_object('x', event_type), '}') d, '$.o.x' p from events) z",
    "select event_id, json_extract_string(props, '$.k') a, json_extract_string(props, '$.k') b, '[' || event_id || ',' || user_id || ']' c, event_type e, event_type f, event_type g, cast(user_id as varchar) h, event_type i from events")
add("json_build", "select c_custkey, json_object('name', c_name, 'n', c_nationkey, 'odd', t) a, json_array(c_custkey, t, null, true) b, json_quote(t) q, json_unquote(json_quote(t)) u, json_valid(json_array(t)) v from (select c_custkey, c_name, c_nationkey, concat(c_mktsegment, '\"\\', c_custkey) t from customer) x",
    "select c_custkey, cast(json_object('name', c_name, 'n', c_nationkey, 'odd', t) as varchar) a, cast(json_array(c_custkey, t, null, true) as varchar) b, cast(to_json(t) as varchar) q, t u, true v from (select *, c_mktsegment || '\"\\' || c_custkey t from customer)")
add("json_inspect", "select event_id, json_type(x) t, json_typeof(x) y, json_length(x) n, json_array_length(l) al, json_valid(x) v, json_depth(x) d, json_contains_path(o, 'one', '$.a', '$.b') c, json_contains_path(o, 'all', '$.a', '$.b') e, json_keys(o)[0] k from (select event_id, case event_id % 6 when 0 then '{\"a\": {\"b\": 1}}' when 1 then '[1, 2, [3]]' when 2 then '5' when 3 then '1.5' when 4 then 'true' else 'null' end x, json_array(event_id, 2) l, if(event_id % 2 = 0, '{\"a\": 1}', '{\"b\": 1, \"a\": 2}') o from events) z",
    "select event_id, case event_id % 6 when 0 then 'OBJECT' when 1 then 'ARRAY' when 2 then 'INTEGER' when 3 then 'DOUBLE' when 4 then 'BOOLEAN' else 'NULL' end t, case event_id % 6 when 0 then 'object' when 1 then 'array' when 2 then 'number' when 3 then 'number' when 4 then 'boolean' else 'null' end y, case event_id % 6 when 1 then 3 when 5 then null else 1 end::bigint n, 2::bigint al, true v, case event_id % 6 when 0 then 3 when 1 then 3 else 1 end::bigint d, true c, event_id % 2 = 1 e, 'a' k from events")
add("json_relations", "select event_id, json_contains(json_array(event_id, user_id, 7), '7') a, json_overlaps(json_array(user_id, 1), '[7, 9]') b, json_equal(json_object('k', user_id), '{\"k\": 7.0}') c, json_intersect(json_array(user_id, 2), '[2, 7]') d, json_diff(json_array(user_id, 500000), '[7]') e, json_union(json_array(500000), json_array(user_id, 500000)) f from events",
    "select event_id, true a, user_id in (7, 9) b, user_id = 7 c, case when user_id = 7 then '[7,2]' else '[2]' end d, case when user_id = 7 then '[500000]' else '[' || user_id || ',500000]' end e, '[500000,' || user_id || ']' f from events")
add("lists_of_rows", "select user_id, array_len(k) n, k[0] first_id, m.click c, array_len(m.keys) kinds from (select user_id, row_to_array(l) k, array_to_row(t, 'event_type', 'n') m from (select user_id, collect_list(event_id) l from events group by user_id) a join (select u, collect_list(event_type, n) t from (select user_id u, event_type, count(1) n from events group by user_id, event_type) q group by u) b on b.u = a.user_id) z",
    "select user_id, count(1) n, arg_min(event_id, (ts, event_id)) first_id, nullif(count(1) filter (where event_type = 'click'), 0) c, count(distinct event_type) kinds from events group by user_id")
add("map_properties", "select event_id, m.size n, m.empty e, array_len(m.keys) k, math.max(m.values) v, array_len(m.entries) x from (select event_id, new_map('a', value, 'b', event_id, 'c', 5) m from events) z",
    "select event_id, 3::bigint n, false e, 3::bigint k, greatest(value, event_id, 5)::double v, 3::bigint x from events")
add("loose_lists", "select event_id, contains_all(array[1, 7, 9], user_id) a, contains_all(array[user_id, event_id], cast(user_id as string), event_id) b, contains_any(array['7', '9'], user_id) c, not_contains(array[event_id, user_id], '7') d, array_len(array[event_id, 'x', null]) e from events",
    "select event_id, user_id in (1, 7, 9) a, true b, user_id in (7, 9) c, 7 not in (event_id, user_id) d, 2::bigint e from events")
add("double_precision", "select event_id, cast(event_id as double precision) d, '2.5'::double precision e from events", "select event_id, event_id::double d, 2.5::double e from events")


# --- operators without a text ----------------------------------------------------------------------
def tumbling_time_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = grouping.tumbling_time(events, F.col("ts"), 600_000, "w").groupBy("w").agg(F.count("*").alias("c"))
    return grouping.dense(counts, "w", 600_000, {"c": 0}).select(F.unix_millis("w").alias("w"), "c")


def window_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import rows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.window_sort(events, ["ts", "event_id"], [F.desc("value"), F.col("event_id")], 100, "b").select("event_id", "b")


def merge_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    a = nation.select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    b = nation.select(F.col("n_nationkey").alias("k"), "n_name", (F.col("n_regionkey") % 2).alias("n_regionkey"))
    return merging.merge_by_key({"a": a, "b": b}, "k", "inner", ordered=False)


QUERIES |= {"tumbling_time_dense": tumbling_time_dense, "window_sort": window_sort, "merge_conflict": merge_conflict}
ORACLE |= {
    "tumbling_time_dense": "with b as (select time_bucket(interval '10 minutes', ts, timestamp '1970-01-01') w, count(1) c from events group by 1) select epoch_ms(s.w) w, coalesce(c, 0) c from (select unnest(generate_series((select min(w) from b), (select max(w) from b), interval '10 minutes')) w) s left join b using (w)",
    "window_sort": "select event_id, (row_number() over (order by ts, event_id) - 1) // 100 b from events",
    "merge_conflict": "select n_nationkey k, n_name, n_regionkey, null::varchar \"b.n_name\", case when n_regionkey % 2 <> n_regionkey then n_regionkey % 2 end \"b.n_regionkey\" from nation",
}
