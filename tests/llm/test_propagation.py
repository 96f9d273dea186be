"""Balanced label propagation against a plain one, document by document."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import common, sharding


def hashed(*values, kinds):
    """Spark's xxhash64: each value's hash is the next one's seed."""
    seed = 42
    for v, kind in zip(values, kinds, strict=True):
        data = v if kind == "b" else struct.pack("<i" if kind == "i" else "<q", v)
        seed = xxhash.xxh64_intdigest(data, seed % (1 << 64))
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute(members, n_shards, rounds):
    """Shards of members (doc_id, crc, gid): each round every linked document asks for one of its group's commonest shards; quotas admit shares of those who ask."""
    shard = [hashed(d, kinds="q") % n_shards for d, _, _ in members]
    sizes = Counter(g for _, _, g in members if g is not None)
    linked = [i for i, (_, _, g) in enumerate(members) if g is not None and sizes[g] > 1]
    quota = max(1, len(members) // n_shards)
    for turn in range(rounds):
        held = defaultdict(Counter)
        for i in linked:
            held[members[i][2]][shard[i]] += 1
        targets = {}
        for g, own in held.items():
            wanted = -(-sizes[g] // quota) + (turn // 3 if 2 * sizes[g] > quota else 0)
            targets[g] = sorted(own, key=lambda s: (-own[s], hashed(g, s, kinds="bi")))[:wanted]  # noqa: B023
        to = {}
        for i in linked:
            t = targets[members[i][2]]
            to[i] = shard[i] if shard[i] in t else t[hashed(members[i][0], turn, kinds="qi") % len(t)]
        flows = Counter((shard[i], to[i]) for i in linked)
        load, asked = Counter(shard[i] for i in linked), Counter(to[i] for i in linked if to[i] != shard[i])
        share = {}
        for s in range(n_shards):
            leaving = sum(min(k, flows[b, a]) for (a, b), k in flows.items() if a == s and b != s)
            share[s] = min(1.0, max(0, quota - load[s] + leaving) / asked[s]) if asked[s] else 0.0
        if sum(asked[s] * share[s] for s in range(n_shards)) < 1:
            break
        for i in linked:
            if hashed(members[i][0], members[i][1], turn, kinds="qqi") % 1_000_003 < int(share[to[i]] * 1_000_003):
                shard[i] = to[i]
    return shard


@pytest.mark.parametrize("n_shards, rounds, texts", [
    (5, 12, [f"t{i % 60}" for i in range(300)]), (4, 12, ["hot"] * 150 + [f"u{i}" for i in range(90)] + [f"p{i // 2}" for i in range(60)]), (3, 2, [None, "", "", "a", "a", "b", None] * 9), (7, 12, [f"g{int(i ** 0.7)}" for i in range(400)]),
])
def test_propagation(spark, n_shards, rounds, texts):
    random.seed(3)
    docs = list(enumerate(texts))
    random.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.lit(1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("gid"))
    found = {r.doc_id: r.shard for r in sharding.propagate(common.materialise(df, "members"), n_shards, rounds).collect()}
    members = [(i, zlib.crc32((t or "").encode()), None if t is None else hashlib.md5(t.encode()).digest()) for i, t in docs]
    assert found == {m[0]: s for m, s in zip(members, brute(members, n_shards, rounds), strict=True)}
    moved = sum(found[i] != hashed(i, kinds="q") % n_shards for i in found)
    assert moved > len(texts) // 10 or rounds < 12
