"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): t bins. In round i < t every shingle is hashed to a bin
and to a value i + [0, 1); in round t + b every shingle goes to bin b. A bin keeps its least value, and the
rounds end when no bin is empty, at the latest after 2 t of them: every coordinate
fills, for sets of any size, and the share of equal coordinates estimates the Jaccard
similarity with the concentration of independent samples.

1. One pass over the texts: number of shingles, a 128-bit digest of the shingle set, and the
   keys of the bands. Texts with equal shingle sets form a class, for which the row with the
   least id stands; copies go no further.
2. Banding: classes with a band key in common are candidates of each other. Each is tied to the
   least id under the key only, so links are as many as rows. The components of these
   ties are groups: two classes that ever met under a key are in the same group.
3. Exact verification: the texts of each group's classes come together and are linked on
   their full shingle sets. One search from class to class finds a spanning forest of the
   links: a class that was reached once isn't compared again, so a group of copies of one
   text costs one comparison each. A group with more shingles than `group_shingles`
   is cut into blocks, and each pair of blocks is searched by a task of its own; every pair
   of classes still meets in some task.
4. Components over the forests.

With t = 160 in 32 bands of 5, a pair at similarity 0.80 has no common key with a probability of
3e-6, one at 0.85 with 7e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_row, join_one, materialise, release, ship, utf8
from ledgerline.llm.components import components

BINS, BANDS = 160, 32
SHINGLE = 5
#: Links need 100 * intersection >= threshold * union.
THRESHOLD = 80
#: Shingles of one group that a task searches; larger groups are cut into blocks.
GROUP_SHINGLES = 2_000_000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROUND_SEEDS = _mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BAND_SEEDS = _mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes; A-Z are lower-cased.

    With fewer words than a shingle has, all words are one shingle. No words, no shingle.
    """
    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(own) - size + 1)
    hashed = np.full(n, np.uint64(min(size, len(own))), np.uint64)
    for i in range(min(size, len(own))):
        hashed = _mix(hashed * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n])
    return np.unique(hashed)


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes (not empty): for each bin its round and 32 bits of hash."""
    out = np.full(bins, _EMPTY, np.uint64)
    n, i = len(hashes), 0
    low = np.uint64(0xFFFFFFFF)
    while i < bins:
        rounds = min(bins - i, max(1, 2 * bins // n))
        x = _mix(hashes[None, :] ^ _ROUND_SEEDS[i : i + rounds, None])
        place = ((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        value = (np.arange(i, i + rounds, dtype=np.uint64)[:, None] << np.uint64(32)) | (x & low)
        np.minimum.at(out, place.ravel().astype(np.intp), value.ravel())
        i += rounds
        if out.max() != _EMPTY:
            return out
    for b in np.flatnonzero(out == _EMPTY):
        x = _mix(hashes ^ _ROUND_SEEDS[bins + b])
        out[b] = (np.uint64(bins + b) << np.uint64(32)) | (x & low).min()
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of a sketch."""
    rows = values.reshape(bands, -1)
    key = _BAND_SEEDS[:bands].copy()
    for i in range(rows.shape[1]):
        key = _mix(key ^ rows[:, i]) + np.uint64(i)
    return key.view(np.int64)


SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sketched(columns: dict[str, pa.Array]) -> dict[str, list]:
    n, keys, bands = [], [], []
    for text in utf8(columns["text"]):
        own = shingles(text)
        n.append(len(own))
        keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
        bands.append(band_keys(sketch(own)) if len(own) else None)
    return {"doc_id": columns["doc_id"], "n_shingles": n, "set_key": keys, "bands": bands}


def spanning_links(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of sorted distinct hashes: pairs of positions, all true links."""
    n = len(sets)
    if n < 2:
        return []
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    rest = np.arange(n)  # not reached yet
    rows, offsets = flat, starts[:-1]
    out: list[tuple[int, int]] = []
    alive = np.ones(n, bool)
    while len(rest):
        first, rest = rest[0], rest[1:]
        rows, offsets = rows[sizes[first] :], offsets[1:] - sizes[first]
        alive = np.ones(len(rest), bool)
        queue = [first]
        while queue and len(rest):
            x = queue.pop()
            own = flat[starts[x] : starts[x + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[rows], offsets)
            mark[own] = 0
            linked = alive & (100 * common >= threshold * (sizes[rest] + sizes[x] - common))
            found = rest[linked]
            out += [(int(x), int(y)) for y in found]
            queue += found.tolist()
            alive &= ~linked
            if alive.sum() * 2 < len(rest) or not queue:
                keep = np.repeat(alive, sizes[rest])
                rest = rest[alive]
                rows = rows[keep]
                offsets = np.concatenate(([0], np.cumsum(sizes[rest])))[:-1]
                alive = np.ones(len(rest), bool)
    return out


LINKED = pa.schema([("left_key", pa.binary()), ("right_key", pa.binary())])


def _link_groups(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (gid, part); a group's rows are linked when the next one begins."""
    now, members = None, {}

    def links() -> pa.RecordBatch:
        keys = sorted(members)
        pairs = spanning_links([members[k] for k in keys], threshold)
        return pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in pairs], pa.binary()), pa.array([keys[b] for _, b in pairs], pa.binary())], schema=LINKED)

    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for gid, part, key, text in zip(columns["gid"].to_pylist(), columns["part"].to_pylist(), columns["set_key"].to_pylist(), utf8(columns["text"]), strict=True):
            if (gid, part) != now:
                if len(members) > 1:
                    yield links()
                now, members = (gid, part), {}
            own = shingles(text)
            if xxhash.xxh3_128_digest(own.tobytes()) == key:  # else another text with the same id
                members[key] = own
    if len(members) > 1:
        yield links()


def _judged(own: DataFrame, threshold: int, group_shingles: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of own (doc_id, text)."""
    spark = own.sparkSession
    ship(spark)
    sketched = materialise(own.mapInArrow(by_row(_sketched, SKETCHED), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    usable = sketched.where("doc_id is not null and set_key is not null")
    row = F.struct("doc_id", "n_shingles", "bands")
    classes = materialise(usable.groupBy("set_key").agg(F.min_by(row, "doc_id").alias("row"), F.count(F.lit(1)).alias("n")).select("set_key", "row.*", "n"), "classes")
    keyed = classes.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    met = keyed.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("pivot != last")
    met = materialise(met.select("band", "pivot", "n"), "met")
    ties = join_one(keyed, met.select("band", "pivot"), "band", counts=met).where("rep != pivot").select("rep", "pivot").distinct()
    groups = components(ties, "rep", "pivot")
    members = classes.select("doc_id", "n_shingles", "set_key").join(groups.withColumnRenamed("node", "doc_id"), "doc_id")
    members = materialise(members.select("doc_id", "set_key", "n_shingles", F.col("root").alias("gid")), "members")
    # blocks of a group: one, unless it has too many shingles; every pair of blocks is a part
    half = max(1, group_shingles // 2)
    sizes = materialise(members.groupBy("gid").agg(F.sum("n_shingles").alias("all"), F.count(F.lit(1)).alias("n")), "sizes")
    blocks = sizes.select("gid", F.when(F.col("all") <= group_shingles, 1).otherwise(F.ceil(F.col("all") / half)).cast("int").alias("n_blocks"))
    placed = join_one(members, blocks, "gid", counts=sizes).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    placed = placed.select("doc_id", "set_key", "gid", "block", other)
    placed = placed.select("doc_id", "set_key", "gid", F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other")).alias("part"))
    # each text is read once and sent to its parts; they grow with the input, so they aren't broadcast at any size
    parts = placed.groupBy("doc_id").agg(F.collect_list(F.struct("set_key", "gid", "part")).alias("places"))
    texts = own.join(parts.hint("merge"), "doc_id").select("text", F.explode("places").alias("place")).select("place.gid", "place.part", "place.set_key", "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    links = texts.repartition(n, "gid", "part").sortWithinPartitions("gid", "part").mapInArrow(lambda batches: _link_groups(batches, threshold), "left_key binary, right_key binary")
    links = materialise(links, "verified")
    roots = components(links, "left_key", "right_key")
    reps = classes.select("set_key", F.col("doc_id").alias("rep"))
    named = materialise(roots.withColumnRenamed("node", "set_key").join(reps, "set_key"), "named")
    smallest = materialise(named.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("n")), "smallest")
    found = join_one(named, smallest.select("root", "component"), "root", counts=smallest).select("set_key", "component")
    all_classes = reps.join(found, "set_key", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    all_classes = materialise(all_classes, "components")
    release(met, members, sizes, links, named, smallest)
    counts = classes.select("set_key", "n")
    out = join_one(sketched.select("doc_id", "n_shingles", "set_key"), all_classes, "set_key", "left", counts)
    id_ = F.when(F.col("doc_id").isNotNull(), F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", id_.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that a document reaches over links) and kept, one row for each row.

    Texts that are null or have no words have no shingles and are linked with nothing. A row
    without an id takes part in no link; its component_id is null, and it is kept. Rows that share an
    id are told apart by their texts. Other columns don't matter, whatever their names.
    """
    return _judged(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), threshold, group_shingles)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row stays, that with the least id (null comes last).

    Rows are judged singly, by numbers of their own: repeated rows, rows without an id and rows that share one are
    documents like others. Texts without words all stay.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row"))
    rows = materialise(rows, "rows")  # the numbers stay
    field = F.col("row").getField
    own = rows.select(F.col("number").alias("doc_id"), field(text_column).alias("text"))
    parts = _judged(own, threshold, GROUP_SHINGLES).select(F.col("doc_id").alias("number"), "component_id")
    ids = rows.select("number", field(id_column).cast("long").alias("id"))
    of = parts.join(ids, "number").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("first"))
    return rows.join(of.select("first.number"), "number", "left_semi").select("row.*")
