"""Line dedup by levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TRIM, Scratch, ascii_lower, partitions, table

LINE = ["h1", "h2"]
ROW = ["r1", "r2"]
#: Lines of a batch, about; at least MIN_BATCHES are taken, so that small inputs go the same way.
BATCH_LINES, MIN_BATCHES, MAX_BATCHES = 20_000_000, 4, 256


class Runs:
    """Levels of runs (h1, h2, n_docs, keeper), each hash once; ``fanout`` runs of a level become one of the next.

    A run is a table of buckets by hash, sorted inside. Spark knows both, and all runs have the same buckets: joins of a
    batch with runs, and merges of runs, read them in place, without a shuffle of theirs.
    """

    def __init__(self, scratch: Scratch, fanout: int = 4) -> None:
        self.scratch, self.fanout, self.levels, self.n = scratch, fanout, [], 0
        self.buckets = partitions(scratch.spark)
        self.name = f"runs_{uuid.uuid4().hex}"

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _write(self, run: DataFrame) -> DataFrame:
        self.n += 1
        name = f"{self.name}_{self.n}"
        placed = run.repartition(self.buckets, *LINE)
        placed.write.bucketBy(self.buckets, *LINE).sortBy(*LINE).option("path", self.scratch.path(f"run{self.n}")).format("parquet").saveAsTable(name)
        return self.scratch.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n_docs, top), each hash once. Its new lines name their keeper, known lines add to the count."""
        known = F.lit(False)
        for k, run in enumerate(self.all()):
            batch = batch.join(run.select(*LINE, F.lit(True).alias(f"in{k}")).hint("merge"), LINE, "left")
            known = known | F.col(f"in{k}").isNotNull()
        self._put(0, self._write(batch.select(*LINE, "n_docs", F.when(~known, F.col("top")).alias("keeper"))))

    def _put(self, k: int, run: DataFrame) -> None:
        if len(self.levels) == k:
            self.levels.append([])
        self.levels[k].append(run)
        if len(self.levels[k]) >= self.fanout:
            some, self.levels[k] = self.levels[k], []
            self._put(k + 1, self._write(merged(some)))

    def forget(self) -> None:
        """Take the runs out of the catalogue; their files stay in the scratch folder."""
        for k in range(1, self.n + 1):
            self.scratch.spark.sql(f"drop table if exists {self.name}_{k}")


def merged(runs: list[DataFrame]) -> DataFrame:
    """The sums of several runs, by merge joins of their buckets."""
    sides = [r.select(*LINE, F.col("n_docs").alias(f"n{k}"), F.col("keeper").alias(f"k{k}")).hint("merge") for k, r in enumerate(runs)]
    out = reduce(lambda a, b: a.join(b, LINE, "full"), sides)
    total = reduce(lambda a, b: a + b, [F.coalesce(f"n{k}", F.lit(0)) for k in range(len(runs))])
    keeper = F.coalesce(*[f"k{k}" for k in range(len(runs))])  # only the run that first brought a line names one
    return out.select(*LINE, total.cast("long").alias("n_docs"), keeper.alias("keeper"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batch_lines: int = BATCH_LINES) -> DataFrame:
    """All columns of docs with ``__lines`` (array of lines) and ``__drop`` (0-based positions that go, or null).

    Documents are taken in batches of falling doc_id, of about ``batch_lines`` lines each, so the batch that first brings a
    line holds its keeper; lines already in the runs only add to the count. Lines are compared by 128 bits of hash over the trimmed key.

    Null or empty text is one empty line. A null doc_id sorts below all others. Rows with equal doc_id and text count
    as one document; rows with equal doc_id and other texts as several, and all that hold the line with the largest
    id keep it. An empty table gives no rows. Columns of docs may have any names but those starting with ``__``.
    """
    spark = docs.sparkSession
    scratch, p = Scratch(spark, "lines"), partitions(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.xxhash64(F.lit(k), "doc_id", text) for k in (1, 2)]
    key = ascii_lower(F.btrim(F.col("line"), F.lit(TRIM)))
    lines = docs.select("doc_id", row[0].alias("r1"), row[1].alias("r2"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", *ROW, "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    lines = scratch.save(lines.select("doc_id", *ROW, "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")), "lines")
    total = lines.count()
    batches = min(MAX_BATCHES, max(MIN_BATCHES, -(-total // batch_lines)))
    cuts = sorted(set(lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], min(0.01, 0.25 / batches))), reverse=True)
    runs, upper = Runs(scratch), None
    for lower in [*cuts, None]:  # lines lie in the order of the documents, so a batch reads few of their files
        batch = lines if upper is None else lines.where((F.col("doc_id") < upper) | F.col("doc_id").isNull())
        batch = batch if lower is None else batch.where(F.col("doc_id") >= lower)
        once = batch.groupBy(*LINE, *ROW).agg(F.max("doc_id").alias("doc_id"))
        runs.add(once.groupBy(*LINE).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top")))
        upper = lower
    common = scratch.save(merged(runs.all()).where(F.col("n_docs") >= min_docs), "common")
    runs.forget()
    limit = max(1, total // (4 * p))
    hot = F.broadcast(common.where(F.col("n_docs") > limit))  # 4 * p lines at most, since each holds over limit rows
    gone = (F.col("doc_id") < F.col("keeper")) | (F.col("doc_id").isNull() & F.col("keeper").isNotNull())
    drop = lines.join(hot, LINE).unionByName(lines.join(hot.select(*LINE), LINE, "left_anti").join(common.where(F.col("n_docs") <= limit), LINE))
    drop = drop.where(gone).groupBy(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).agg(F.collect_set("pos").alias("__drop"))
    drop = scratch.save(drop, "drop")
    marked = docs.withColumns({"__k1": row[0], "__k2": row[1]})
    joined = marked.join(drop, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left")
    return joined.withColumn("__lines", F.split(text, "\n", -1)).drop("__k1", "__k2", "__r1", "__r2")


def kept_text() -> F.Column:
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    return F.when(F.col("__drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = F.greatest(F.coalesce(F.size("__drop"), F.lit(0)), F.lit(0))  # the size of null is null or -1, as the session says
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("__lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.sha2(kept_text(), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; a null text stays null, and n_chars follows the text."""
    out = dedup_lines(docs).withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(kept_text()))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = r"""
with l as (
    select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)
), c as (select k, max(doc_id) as top from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
m as (select l.doc_id, l.pos, l.line, c.top is not null and l.doc_id < c.top as gone from l left join c on l.k = c.k)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
