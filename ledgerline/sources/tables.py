"""Tables in generations, overlays and merges."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of this context's own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark.sparkContext, "_ledgerline_root", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="ledgerline-shared-")
            spark.sparkContext._ledgerline_root = root
    return root.rstrip("/")


def step_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; all that this application wrote there goes when the driver ends."""
    sc = spark.sparkContext
    base = f"{shared_root(spark)}/ledgerline/{sc.applicationId}"
    if getattr(sc, "_ledgerline_steps", None) != base:
        sc._ledgerline_steps = base
        atexit.register(_delete, sc._jvm, sc._jsc.hadoopConfiguration(), base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str, shuffled: bool = False) -> DataFrame:
    """Write a step's result to the shared folder and read it back.

    shuffled: it joins by shuffle, whatever size its files say: repetitive rows pack so well that millions of them look small enough to be sent through the driver.
    """
    path = step_path(df.sparkSession, label)
    df.write.option("compression", "lz4").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if shuffled:
        out = out.hint("merge")
    out._ledgerline_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as a shuffle has: for steps whose rows take far longer than their way through one. A small file is read in one task, and what follows stays there, however long it takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(*steps: DataFrame) -> None:
    """Delete steps that nothing reads any more."""
    for df in steps:
        path = getattr(df, "_ledgerline_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            _delete(sc._jvm, sc._jsc.hadoopConfiguration(), path)


def _delete(jvm, configuration, path: str) -> None:
    try:
        own = jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(configuration).delete(own, True)
    except (Py4JError, ConnectionError):  # the JVM went before
        pass


#: The commonest keys that are sought, and rows of one key that meet in a task on small tables.
HUBS, HUB_ROWS = 10_000, 256


def hubs_of(rows: DataFrame, key: str) -> DataFrame | None:
    """The commonest keys of a table, HUBS at most, and to how many tasks each one's rows are dealt; None without any. Another key has at most 1/HUBS of the rows."""
    spark = rows.sparkSession
    hubs = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_ROWS).orderBy(F.desc("n")).limit(HUBS)
    found = hubs.collect()  # at most HUBS rows
    if not found:
        return None
    most = max(HUB_ROWS, sum(r["n"] for r in found) // HUBS)
    return spark.createDataFrame([(r[key], -(-r["n"] // most)) for r in found], hubs.select(key, F.lit(0).alias("_deals")).schema)


def deal(rows: DataFrame, one: DataFrame, key: str, hubs: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row for each key; a hub's rows are dealt to several tasks, each of which gets its row of `one`. rows is a written table, so that it has the same order if a task is redone."""
    if hubs is None:
        return rows.join(one, key, how)
    deals = F.broadcast(hubs)
    dealt = rows.join(deals, key, "left").withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals")
    sent = one.join(deals, key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    return dealt.join(sent, [key, "_deal"], how).drop("_deal")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, below: str = "below") -> DataFrame:
    """df with the sum of weight over the rows before each, in order, among those with the same keys.

    The rows are dealt by ranges of (keys, order) and written; sums of whole ranges, of which there are as many as shuffle
    partitions, give what each range starts from, and a window within a range gives the rest: no key is sorted in one task.
    Rows that are equal in keys and order should be summed first.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*keys, "_range").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    matched = F.col("_range") == F.col("_r")
    for k in keys:
        matched = matched & dealt[k].eqNullSafe(F.col(f"_k_{k}"))
    joined = dealt.join(starts.select(F.col("_range").alias("_r"), "_start", *(F.col(k).alias(f"_k_{k}") for k in keys)), matched)
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(below, F.col("_start") + F.coalesce(F.sum(weight).over(within), F.lit(0))).select(*df.columns, below)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot_id(df: DataFrame, key: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row with an identity of a table's rows, whatever their order: SHA-256 over the sorted SHA-256 of all rows, by chunk of hashes first."""
    own = [c for c in sorted(df.columns) if c not in exclude]
    hashed = df.select(F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    parts = hashed.groupBy(F.substring("h", 1, 3).alias("chunk")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("h", "n")))), 256).alias("part"))
    whole = F.sha2(F.concat_ws("|", F.lit(key), F.to_json(F.array_sort(F.collect_list(F.struct("chunk", "part"))))), 256)
    return parts.agg(whole.alias("snapshot_id"))


def publish(df: DataFrame, root: str, key: str) -> str:
    """Write a generation and make it the active one, unless the active one has the same rows; returns the active generation's id.

    Pointers are small numbered tables, written last; the newest whole one counts, so that readers always see the old generation
    or the new one. The generation before stays as a backup. Writers take turns: of two at once one fails.
    """
    spark = df.sparkSession
    identity = snapshot_id(df, key).first()[0]
    active = _pointer(spark, root)
    if active and active[0] == identity and _readable(spark, f"{root}/generations/{active[0]}"):
        return identity
    if not _readable(spark, f"{root}/generations/{identity}"):
        df.write.mode("overwrite").parquet(f"{root}/generations/{identity}")
    latest = spark.createDataFrame([(identity, active[0] if active else None)], "active string, backup string")
    latest.coalesce(1).write.mode("errorifexists").parquet(f"{root}/pointers/{(_pointers(spark, root) or [0])[-1] + 1:012d}")
    return identity


def read_generation(spark: SparkSession, root: str) -> DataFrame | None:
    """The active generation, or the backup where it can't be read."""
    for identity in _pointer(spark, root) or ():
        if identity and _readable(spark, f"{root}/generations/{identity}"):
            return spark.read.parquet(f"{root}/generations/{identity}")
    return None


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def _readable(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/_SUCCESS")


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all pointers, whole or not."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    system = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()) for x in system.listStatus(own) if x.getPath().getName().isdigit()) if system.exists(own) else []


def _pointer(spark: SparkSession, root: str) -> tuple[str, str | None] | None:
    for number in reversed(_pointers(spark, root)):
        path = f"{root}/pointers/{number:012d}"
        if _readable(spark, path) and (row := spark.read.parquet(path).first()):
            return row[0], row[1]
    return None


def merge(old: DataFrame, delta: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """Upsert delta's rows by key, and drop the deleted keys."""
    out = old.join(delta.select(key), key, "left_anti").unionByName(delta)
    return out if deleted is None else out.join(deleted.select(key), key, "left_anti")


def changed_rows(previous: DataFrame, current: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, status): changed where the hash is new or another, deleted where it is gone. A row that had no hash is never deleted."""
    a, b = previous.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was")), current.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    status = F.when(F.col("_is") & ~F.col("_old").eqNullSafe(F.col("_new")), "changed").when(F.col("_is").isNull() & F.col("_old").isNotNull(), "deleted")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def overlay(base: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Base rows with the pending ones in place of theirs."""
    return base.join(pending.select(key), key, "left_anti").unionByName(pending)


def replace_source(edges: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """Edges of one source replaced by those found now, with low confidence."""
    return edges.where(F.col("source") != source).unionByName(found.select(*[c for c in edges.columns if c not in ("source", "confidence")], F.lit(source).alias("source"), F.lit("low").alias("confidence")).select(edges.columns))


def inspect_generations(spark: SparkSession, root: str) -> DataFrame:
    """(generation, role, whole) of what is below root: active, backup, or left over."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/generations")
    system = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in system.listStatus(own)) if system.exists(own) else []
    active, backup = _pointer(spark, root) or (None, None)
    return spark.createDataFrame([(n, "active" if n == active else "backup" if n == backup else "left", _readable(spark, f"{root}/generations/{n}")) for n in names], "generation string, role string, whole boolean")


def discovered(edges: DataFrame, found: DataFrame, source: str, keys: Sequence[str] = ("src", "dst")) -> tuple[DataFrame, DataFrame]:
    """(edges with one source's replaced by those found now; one row: how many of them came and went)."""
    old, new = edges.where(F.col("source") == source).select(*keys).distinct(), found.select(*keys).distinct()
    counts = new.join(old, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("added")).join(old.join(new, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("removed")))
    return replace_source(edges, found, source), counts
