"""What the training-data operators share: shipping code, cutting lineage, batches."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(str(path.relative_to(package.parent))), path.read_bytes())
    data = buffer.getvalue()
    path = Path(tempfile.mkdtemp(prefix="ledgerline-")) / f"ledgerline-{hashlib.sha256(data).hexdigest()[:12]}.zip"
    path.write_bytes(data)
    sc.addPyFile(str(path))
    sc._ledgerline_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of this session's own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark.sparkContext, "_ledgerline_root", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="ledgerline-shared-")
            spark.sparkContext._ledgerline_root = root
    return root.rstrip("/")


def own_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; all that this application wrote there goes when the driver ends."""
    sc = spark.sparkContext
    base = f"{shared_root(spark)}/ledgerline/{sc.applicationId}"
    if getattr(sc, "_ledgerline_folder", None) != base:
        sc._ledgerline_folder = base
        atexit.register(_delete, sc._jvm, sc._jsc.hadoopConfiguration(), base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def _delete(jvm, configuration, path: str) -> None:
    try:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(configuration).delete(hadoop, True)
    except (Py4JError, ConnectionError):  # the JVM went before
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.option("compression", "lz4").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerline_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_ledgerline_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            _delete(sc._jvm, sc._jsc.hadoopConfiguration(), path)


#: Rows that hold more than this share of a table under one key make the key a hub; there are fewer than HUBS of them.
HUBS = 10_000
#: Rows of a hub that meet in one task, about, on small tables.
HUB_ROWS = 256


def join_one(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, deal: Column | None = None) -> DataFrame:
    """rows joined with a table of one row for each key, without bringing a hub's rows together.

    The HUBS commonest keys of rows are sought (`counts`: their rows by key, as n, where that is known);
    those with many rows are dealt to several tasks, to each of which `one` sends its row for the key. Any other key
    has at most 1/HUBS of all rows. Rows without a key, which a left join keeps, are dealt too. The caller materialises
    rows, so that their order is the same if a task is redone, or names what deals them: a hash of the row's own columns (`deal`).
    """
    spark = rows.sparkSession
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hubs = counts.where(F.col("n") > HUB_ROWS).select(key, "n").orderBy(F.desc("n")).limit(HUBS)
    found = hubs.collect()  # at most HUBS rows
    if not found and how == "inner":
        return rows.join(one, key, how)
    most = max(HUB_ROWS, sum(r["n"] for r in found) // HUBS)
    deals = F.broadcast(spark.createDataFrame([(r[0], -(-r["n"] // most)) for r in found], hubs.select(key, F.lit(0).alias("_deals")).schema))
    dealt = rows.join(deals, key, "left").withColumn("_deal", F.pmod(F.monotonically_increasing_id() if deal is None else deal, F.when(F.col(key).isNull(), HUBS).otherwise(F.coalesce("_deals", F.lit(1)))).cast("int")).drop("_deals")
    sent = one.join(deals, key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    return dealt.join(sent, [key, "_deal"], how).drop("_deal")


#: Rows and bytes of text that a function takes at once; a longer text is taken by itself.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def parts_of(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))))
        yield batch.slice(start, end - start)
        start = end


def by_row(function: Callable, schema: pa.Schema, rows: int = BATCH_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: function takes a batch as arrays by column name and gives lists by column name; large batches are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, rows):
                out = function({n: part.column(i) for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str | None]:
    """The texts of a string column; bytes that aren't UTF-8 become U+FFFD, as in Python's "replace"."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, root: str | None = None) -> str:
    """A public tokenizer's file: in root, or where the installed public_tokenizers package keeps it."""
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
