"""Helpers shared by the operators: lineage cuts, checked broadcasts, guards."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A side is broadcast only when the optimizer's own size estimate is at most this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    A private folder is made only where the setting is absent and all tasks run on this
    machine; on a cluster each executor would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-hazardframe-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


#: Scratch paths handed out in this process, oldest first.
CREATED: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    CREATED.append(f"{work_dir(spark)}/hazardframe/{label}-{uuid.uuid4().hex}")
    return CREATED[-1]


def keep_only(df: DataFrame, label: str, since: int) -> DataFrame:
    """``df`` written once; scratch tables made after ``CREATED`` had ``since`` entries are removed.

    For operators whose last step reads ``df`` alone of what they wrote.
    """
    out, spark = materialise(df, label), df.sparkSession
    for path in CREATED[since:-1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del CREATED[since:-1]
    return out


#: Rows of one task before a CPU-heavy step.
TASK_ROWS = 20_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt evenly before a CPU-heavy step, about ``rows`` to a task and at least one task a core.

    File splits do not bound a task: a row group of short packed rows belongs to one split, whatever it holds.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks)


#: Rows in memory take many times the bytes of their Parquet files: sorted keys and nested ids pack to a byte a row or less.
FILE_TO_MEMORY = 16.0


def size_files_as_rows(spark: SparkSession) -> None:
    """Let Spark estimate file tables at ``FILE_TO_MEMORY`` times their packed size, at least.

    Otherwise a join broadcasts whatever is below its threshold on disk, and the driver has to hold
    the rows. AQE still broadcasts by measured sizes.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) < FILE_TO_MEMORY:
        spark.conf.set(key, str(FILE_TO_MEMORY))


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative plans. The table survives executor loss, is computed
    once, and keeps columnar pruning and its size for the next join. Shuffle files of the write go
    with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.select("*").write.parquet(path)  # a frame takes the setting that holds when it is made
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialise_observed(df: DataFrame, label: str, **metrics) -> tuple[DataFrame, dict]:
    """``materialise`` that also returns aggregates of the rows, taken while writing them."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), label)
    return out, seen.get


def fingerprint(*cols) -> Column:
    """Order-independent checksum of the rows' columns, to detect that a loop has settled."""
    h = F.xxhash64(*cols)
    return F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)")))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint only when the estimated size is within ``limit``.

    Beyond it the frame is returned as is, and Spark (with AQE) picks a shuffled join.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def require_empty(df: DataFrame, message: str) -> None:
    """Raise when a frame of offending rows has any row; the first few are shown."""
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: " + "; ".join(str(r.asDict()) for r in bad))


def distinct_cells(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def attach_all(big: DataFrame, little: DataFrame, salts: int = 64) -> DataFrame:
    """Every row of ``big`` with every row of ``little`` (a short list such as a run's hours).

    The list is broadcast after a size check; beyond the limit it is copied to ``salts``
    groups, so the work stays spread over the cluster.
    """
    if estimated_bytes(little) <= BROADCAST_LIMIT_BYTES:
        l1 = F.broadcast(little.withColumn("_k", F.lit(0)))
        return big.withColumn("_k", F.lit(0)).join(l1, "_k").drop("_k")
    l2 = little.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_k", (F.monotonically_increasing_id() % salts).cast("int")).join(l2, "_k").drop("_k")


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based position of every row in a total order, without one task holding all rows.

    Rows are written in order ranges; a row's position is its position in the range plus
    the sizes of the ranges before it.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_b").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_off", F.sum("_c").over(W.orderBy("_b")) - F.col("_c")).drop("_c")
    pos = F.row_number().over(W.partitionBy("_b").orderBy(*order)) + F.col("_off")
    return ranged.join(F.broadcast(sizes), "_b").withColumn(name, pos).drop("_b", "_off")


def aggregate_with_percentiles(df: DataFrame, keys: list[str], aggs: list[Column], value: Column, wanted: dict[str, float]) -> DataFrame:
    """``aggs`` per group, and exact interpolated percentiles of ``value`` (name -> share).

    Values are counted first, then laid out in order ranges; a percentile is picked by its
    position from cumulative counts. No task holds the values of a group, however large.
    Nulls have no position; groups without values get nulls. Without keys there is one row.
    """
    own = keys or ["_all"]
    df = materialise(df.withColumn("_v", value.cast("double")).withColumn("_all", F.lit(0)), "measured")
    counted = df.filter(F.col("_v").isNotNull()).groupBy(*own, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = materialise(counted.repartitionByRange(*own, "_v").withColumn("_b", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_b").agg(F.sum("_n").alias("_c"))  # one row per range
    sizes = sizes.withColumn("_off", F.sum("_c").over(W.orderBy("_b")) - F.col("_c")).drop("_c")
    upto = F.sum("_n").over(W.partitionBy("_b").orderBy(*own, "_v").rowsBetween(W.unboundedPreceding, 0)) + F.col("_off")
    at = ranged.join(F.broadcast(sizes), "_b").withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_n"))
    total = at.groupBy(*own).agg(F.sum("_n").alias("_total"), F.min("_lo").alias("_base"))
    at = at.join(total, own)
    picks = []
    for name, share in wanted.items():
        place = (F.col("_total") - 1) * F.lit(share)
        for tag, i in (("a", F.floor(place)), ("b", F.ceil(place))):
            picks.append(F.max(F.when((F.col("_lo") - F.col("_base") <= i) & (i < F.col("_hi") - F.col("_base")), F.col("_v"))).alias(f"_{name}_{tag}"))
    found = at.groupBy(*own, "_total").agg(*picks)
    for name, share in wanted.items():
        place = (F.col("_total") - 1) * F.lit(share)
        lo, hi = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        found = found.withColumn(name, F.when(F.floor(place) == F.ceil(place), lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi))
    if keys:
        return df.groupBy(*keys).agg(*aggs).join(found.select(*keys, *wanted), keys, "left")
    one = df.agg(*aggs).withColumn("_all", F.lit(0))
    return one.join(found.select("_all", *wanted), "_all", "left").drop("_all")
