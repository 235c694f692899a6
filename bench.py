"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from sluice.catalog import QUERIES
from sluice.operators import merging
from sluice.session import Engine

HEADLINE = [
    "group_having", "predicate_mix", "loose_compare", "pricing_summary", "agg_unique_count", "agg_distinct_count", "join_inner", "join_left", "exists", "merge_full", "merge_dup_zip", "tumbling_time",
    "sliding_count", "combine_latest", "zip_two", "row_index_elapsed", "take_first_n", "topn_offset", "json_get", "string_functions", "date_functions", "datediff_periods",
]


def generated(spark: SparkSession) -> dict[str, DataFrame]:
    million = spark.range(1_000_000).withColumnRenamed("id", "this")
    docs = spark.range(20_000).selectExpr("concat('{\"a\":{\"b\":', id, '}}') j", "concat('x,', id, ',y') s", "timestamp_millis(id * 1000) t")
    e = Engine(spark).register("m", million, ["this"]).register("d", docs, ["t"])
    sides = {n: spark.range(200_000).selectExpr(f"id * {k} k", f"id {n}") for n, k in (("a", 2), ("b", 3))}
    return {
        "like_count": e.sql("select count(1) c from m"),
        "like_count_where": e.sql("select count(1) c from m where this > 10 and this < 900000"),
        "like_count_unique": e.sql("select count(unique this) c from m"),
        "like_loose_filter": e.sql("select this from m where this > 'x'"),
        "like_json_get": e.sql("select json_get(j, '$.a.b') x from d"),
        "like_text_and_time": e.sql("select split_part(s, ',', 2) a, str_contains(s, 'x') b, date_diff(date_add(t, 1, 'day'), t, 'hour') c from d"),
        "like_merge": merging.merge_by_key(sides, "k"),
    }


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    made = {name: (lambda n=name: QUERIES[n](spark, sf_dir)) for name in HEADLINE}
    made |= {name: (lambda n=name: generated(spark)[n]) for name in generated(spark)}
    for name, make in made.items():
        make().write.format("noop").mode("overwrite").save()  # compile code once
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
