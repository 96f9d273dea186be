"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each starts in a shard by the hash of its id; then, round by round, a
group counts its members by shard and a member elsewhere moves to where most of its
neighbours are. A group too large for one shard has as many shards as it needs. Moves into
a shard are admitted up to its quota of linked documents, by a hash of the document, so
that no round overfills a shard and none needs an order over all documents. At the end shards over their exact
quota give up documents, unlinked ones first, to those under it: counts are at most one apart (law `rows`).

Propagation ends after `rounds` rounds, or when shards have room for none of the moves that are left; where linked
documents fill most of all quotas, groups may still be cut then. `cut` counts what is.

A group is only ever a row for each shard it has members in; its members are never brought together. The
only things on the driver are tables of shards by shards. Positions in a shard come from counts by chunk
of about CHUNK documents and an order within each, so no shard is sorted in one task.

Null texts are linked with nothing and have only the 8 bytes of a document. A null id is an id like others.
Repeated rows are documents of their own. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import join_one, materialise, release

SHARDS = 24
#: Rounds of propagation at most.
ROUNDS = 12
#: Documents of one chunk and shard that are put in order together, about.
CHUNK = 4_000


def _ranked(df: DataFrame, keys: list[str], n_rows: int, name: str, together: Column | None = None) -> DataFrame:
    """df with the place, from 0, of each row among those with the same keys, in a fixed order; rows with the same `together`, if not null, follow each other."""
    chunks = max(1, n_rows // CHUNK)
    own_hash = F.xxhash64("doc_id", "text_crc32", F.lit(name))
    df = df.withColumn("group", F.lit(None).cast("long") if together is None else together).withColumn("chunk", F.pmod(F.coalesce("group", own_hash), F.lit(chunks)).cast("int"))
    counts = df.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy(*keys, "chunk").orderBy("group", "doc_id", "text_crc32", "size")
    return df.withColumn("own", F.row_number().over(own)).join(offsets, [*keys, "chunk"]).withColumn(name, F.col("offset") + F.col("own") - 1).drop("chunk", "own", "offset", "group")


def _by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), shard + 1)


def propagate(members: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """members (doc_id, size, text_crc32, gid: null for unlinked) with shard; the caller materialises members.

    Moves in a round go from one table in the shared folder to the next.
    """
    state = members.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))
    sizes = materialise(members.where("gid is not null").groupBy("gid").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    state = join_one(state, sizes, "gid", "left", sizes.select("gid", F.col("m").alias("n")))
    state = materialise(state.withColumn("linked", F.col("m").isNotNull()), "shards")
    n = state.count()
    quota = max(1, n // n_shards)
    for turn in range(rounds):
        linked = state.where("linked")
        held = linked.groupBy("gid", "shard", "m").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("gid").orderBy(F.desc("n"), F.xxhash64("gid", "shard"))
        # at most a row for each shard of a group
        ranked = held.withColumns({"place": F.row_number().over(order), "wanted": F.ceil(F.col("m") / quota) + F.when(2 * F.col("m") > quota, turn // 3).otherwise(0)})  # a large group that finds no room takes one more shard
        targets = ranked.where("place <= wanted").groupBy("gid").agg(F.collect_list("shard").alias("targets"))
        moving = join_one(linked, targets, "gid", counts=sizes.select("gid", F.col("m").alias("n"))).withColumn("to", F.when(F.array_contains("targets", F.col("shard")), F.col("shard")).otherwise(F.element_at("targets", (F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.size("targets")) + 1).cast("int"))))
        moving = materialise(moving.drop("targets"), "moves")
        flows = {(r[0], r[1]): r[2] for r in moving.groupBy("shard", "to").count().collect()}  # shards by shards
        loads, asked = [0] * n_shards, [0] * n_shards
        for (a, b), k in flows.items():
            loads[a] += k
            asked[b] += k * (a != b)
        leaving = [sum(min(k, flows.get((b, a), 0)) for (a, b), k in flows.items() if a == s and b != s) for s in range(n_shards)]  # those for whom as many come
        shares = [min(1.0, max(0, quota - loads[s] + leaving[s]) / asked[s]) if asked[s] else 0.0 for s in range(n_shards)]
        if sum(a * s for a, s in zip(asked, shares, strict=True)) < 1:
            release(moving)
            break
        admitted = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(turn)), F.lit(1_000_003)) < F.floor(F.element_at(F.array(*map(F.lit, shares)), F.col("to") + 1) * 1_000_003)
        moved = moving.withColumn("shard", F.when(admitted, F.col("to")).otherwise(F.col("shard"))).drop("to").select(state.columns)
        new = materialise(moved.unionByName(state.where("not linked")), "shards")
        release(state, moving)
        state = new
    release(sizes)
    return state


def level(state: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """state with shards whose counts are at most one apart: those over their quota give up unlinked documents first."""
    loads = {r[0]: r[1] for r in state.groupBy("shard").count().collect()}  # a row for each shard
    n = sum(loads.values())
    over = [loads.get(s, 0) - (n // n_shards + (s < n % n_shards)) for s in range(n_shards)]
    order = F.when(F.col("linked"), 1).otherwise(0)
    unlinked = {r[0]: r[1] for r in state.where("not linked").groupBy("shard").count().collect()}
    # small groups are given up, and taken in, as wholes; the members of large ones are dealt to many chunks
    together = F.when(F.col("linked") & (F.col("m") <= CHUNK), F.xxhash64("gid"))
    ranked = _ranked(state.withColumn("kind", order), ["shard", "kind"], n, "place", together)
    place = F.col("place") + F.when(F.col("kind") == 1, _by_shard([unlinked.get(s, 0) for s in range(n_shards)], F.col("shard"))).otherwise(0)
    given = [max(0, x) for x in over]
    number = place + _by_shard([sum(given[:s]) for s in range(n_shards)], F.col("shard"))
    lacking = [max(0, -x) for x in over]
    filled = [sum(lacking[: s + 1]) for s in range(n_shards)]
    to = sum((F.when(number >= x, 1).otherwise(0) for x in filled[1:]), F.when(number >= filled[0], 1).otherwise(0))
    return ranked.withColumn("shard", F.when(place < _by_shard(given, F.col("shard")), to).otherwise(F.col("shard")).cast("int")).drop("kind", "place")


def shard(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot (gapless from 0 in its shard) and grown_shard (null), a row for each row of docs."""
    text = F.col(text_column)
    members = docs.select(F.col(id_column).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("gid"))
    members = materialise(members, "members")
    state = propagate(members, n_shards, rounds)
    settled = materialise(level(state, n_shards), "settled")
    release(members, state)
    out = _ranked(settled, ["shard"], settled.count(), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "gid")


def cut(shards: DataFrame, group: str = "gid", shard_column: str = "shard") -> DataFrame:
    """One row: linked pairs in all, and those whose documents are in different shards."""
    held = shards.where(F.col(group).isNotNull()).groupBy(group, shard_column).agg(F.count(F.lit(1)).alias("n"))
    pairs = held.groupBy(group).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return pairs.agg(F.sum(F.expr("m * (m - 1) div 2")).alias("links"), F.sum(F.expr("(m * m - squares) div 2")).alias("cut_links"))
