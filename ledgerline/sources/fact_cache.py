"""Facts kept by content: what a file's facts are is computed once for each content, however often and under whatever path it comes.

The cache is a log of Parquet tables in a shared folder, each with the facts of contents that were new to a run. A content's key is SHA-256 of the schema of facts, what was asked (a pattern, a version) and the
content, so another question never meets an old answer. A run joins its contents' keys with those of the log; only what is missing is computed, each content once, and appended. Eviction writes the log anew
without entries beyond an age or, the least recently used first, beyond a number and a number of bytes. Broken or half-written tables are never read: a table counts when its writer has ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.tables import cut_lineage, prefix_sums, publish, read_generation

#: Fixed values of the cache: entries, bytes of one, and days that it is kept.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_DAYS = 1024, 4 << 20, 30


def content_key(content: Column, question: str, schema: str) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(schema), F.lit(question), F.coalesce(content, F.lit(""))), 256)


def cached(files: DataFrame, facts: Callable[[DataFrame], DataFrame], root: str, question: str, schema: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts of files, misses): facts (path, language, content) -> (path, and struct or array columns by schema), from the cache below root where it has them.

    files: path, language, content. misses: the keys that were computed in this run. Facts over MAX_ENTRY_BYTES are given but not kept.
    """
    spark = files.sparkSession
    now = F.current_timestamp() if now is None else now
    keyed = files.withColumn("_key", content_key(F.concat_ws("\0", "language", "content"), question, schema))
    asked = cut_lineage(keyed.select("path", "_key"), "asked")
    log = read_generation(spark, root)
    keys = asked.select("_key").distinct()
    known = log.join(keys, "_key", "left_semi") if log is not None else None
    missing = keys if known is None else keys.join(known.select("_key"), "_key", "left_anti")
    # one file stands for each content that is new; only these are read again
    one = keyed.join(missing, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct("path", "language", "content")).alias("f"))
    made = facts(one.select(F.col("_key").alias("path"), "f.language", "f.content")).withColumnRenamed("path", "_key")
    columns = [c for c in made.columns if c != "_key"]
    fresh = cut_lineage(made.groupBy("_key").agg(F.collect_list(F.struct(*columns)).alias("facts")), "fresh")
    empty = missing.join(fresh, "_key", "left_anti").select("_key", F.lit(None).cast(fresh.schema["facts"].dataType).alias("facts"))  # a content without facts is known too
    fresh = fresh.unionByName(empty).select("_key", F.coalesce("facts", F.array().cast(fresh.schema["facts"].dataType)).alias("facts"))
    fresh = cut_lineage(fresh.select("_key", "facts", now.alias("used"), F.octet_length(F.to_json("facts")).cast("long").alias("bytes")), "fresh")
    kept = fresh.where(F.col("bytes") <= MAX_ENTRY_BYTES)
    if log is None:
        publish(kept, root, "facts")
    else:
        hit = keys.withColumn("_hit", F.lit(True))
        touched = log.join(hit, "_key", "left").select("_key", "facts", F.when(F.col("_hit"), F.greatest("used", now)).otherwise(F.col("used")).alias("used"), "bytes")
        publish(cut_lineage(touched.unionByName(kept), "log"), root, "facts")
    whole = fresh.select("_key", "facts") if known is None else fresh.select("_key", "facts").unionByName(known.select("_key", "facts"))
    out = asked.join(whole, "_key").select("path", F.explode("facts").alias("f")).select("path", "f.*")
    return out, fresh.select("_key")


def evict(root: str, log: DataFrame, now: Column, entries: int = MAX_ENTRIES, total: int | None = None, days: int = MAX_DAYS) -> DataFrame:
    """Publish the cache without entries older than so many days, nor, the least recently used first, beyond a number of entries and of bytes; what stays."""
    young = log.where(F.col("used") >= now - F.expr(f"INTERVAL {days} DAYS"))
    turn = cut_lineage(young.select("_key", (-F.unix_micros("used")).alias("_age"), "bytes"), "turn")
    ranked = prefix_sums(turn.withColumn("_one", F.lit(1).cast("long")), [], ["_age", "_key"], "_one", "_before")
    if total is not None:
        ranked = prefix_sums(ranked, [], ["_age", "_key"], "bytes", "_bytes").where(F.col("_bytes") + F.col("bytes") <= total)
    kept = cut_lineage(log.join(ranked.where(F.col("_before") < entries).select("_key"), "_key", "left_semi"), "kept")
    publish(kept, root, "facts")
    return kept
