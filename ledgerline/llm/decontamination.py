"""Benchmark decontamination by spaced seeds.

Tokens are words in lower case without punctuation. A seed is a mask over a window of tokens: the
hash of the positions that the mask keeps, so that a substituted word at an ignored position doesn't
change it. The test items' seeds are joined with those of every window of every document; around each
hit the item is laid along the document, and the stretch with the best score (a match counts 1, a
substitution -SUBSTITUTION) decides. A document contains an item if that stretch has at least `min_matches`
matching words (or all of a shorter item's), `min_share` of the item's, and `min_identity` of its own.

The documents are read once for each block of the benchmark and never shuffled; a block is a hash table of
at most `block_tokens` tokens, the only thing sent to the executors. Larger benchmarks take more blocks,
each with a result of its own in the shared folder.

Hits are laid and verified in chunks of about `PAIRS` pairs of a window and an item's place, so that a passage shared
by many items and documents needs no more memory than others.

Items without words are contained in nothing. Items shorter than every mask are found as a whole,
without substitutions. Null and empty texts contain nothing. Words are compared as bytes, so that those which
aren't UTF-8 are like others. Repeated items and documents each give
their rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, parts_of, release, ship, utf8

#: Masks that keep 6 tokens. With DEFAULTS, every stretch that verification accepts holds a window of one of them in
#: which all kept positions match (the tests search all patterns), so no accepted overlap is missed.
MASKS = ("1110111", "1111011", "111111")
SPANS = tuple(map(len, MASKS))
SUBSTITUTION = 3
BLOCK_TOKENS = 1_000_000
PAIRS = 1_000_000
DEFAULTS = {"min_matches": 10, "min_share": 0.5, "min_identity": 0.8}

_LOWER = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode())
_ODD = (np.arange(1, max(SPANS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BITS = 22


def tokens(text: bytes) -> np.ndarray:
    """A text's tokens as 64-bit hashes."""
    words = text.translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def seeds(own: np.ndarray, mask: int) -> np.ndarray:
    """The seed of each window under a mask; MASKS and then, by length from 1, all of a window shorter than any mask."""
    keep = [i for i, c in enumerate(MASKS[mask]) if c == "1"] if mask < len(MASKS) else list(range(mask - len(MASKS) + 1))
    n = len(own) - (SPANS[mask] if mask < len(MASKS) else len(keep)) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, 0xA0761D6478BD642F ^ (mask + 1), np.uint64)
    for i in keep:
        total += own[i : i + n] * _ODD[i]
    return _finish(total)


@dataclass
class Block:
    """Items and their seeds, sorted; `bits` tells of most hashes that they are none."""

    items: list[int | None]
    tokens: list[np.ndarray]
    masks: list[int]
    hashes: np.ndarray
    item_of: np.ndarray
    place_of: np.ndarray
    bits: np.ndarray


def block_of(items: list[tuple[int | None, bytes]]) -> Block:
    own = [(i, t) for i, t in ((i, tokens(x)) for i, x in items) if len(t)]
    hashes, item_of, place_of, masks = [], [], [], set()
    for k, (_, t) in enumerate(own):
        for mask in [m for m, span in enumerate(SPANS) if span <= len(t)] or [len(MASKS) + len(t) - 1]:
            s = seeds(t, mask)
            masks.add(mask)
            hashes.append(s)
            item_of.append(np.full(len(s), k))
            place_of.append(np.arange(len(s)))
    both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (hashes, item_of, place_of)]
    all_ = both[0].astype(np.uint64)
    order = np.argsort(all_, kind="stable")
    bits = np.zeros(1 << _BITS, bool)
    bits[(all_ >> np.uint64(64 - _BITS)).astype(np.intp)] = True
    return Block([i for i, _ in own], [t for _, t in own], sorted(masks), all_[order], both[1][order], both[2][order], bits)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Matches and length of the stretch with the best score; of equal ones the first."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -SUBSTITUTION))))
    low = np.minimum.accumulate(sums[:-1])
    end = int((sums[1:] - low).argmax())
    start = int(sums[: end + 1].argmin())
    return int(equal[start : end + 1].sum()), end + 1 - start


def _laid(block: Block, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Items (positions in the block) and the places in flat where a seed lays them, in chunks by place; a pair comes once in its chunk."""
    places, lows, counts = [], [], []
    for mask in block.masks:
        own = seeds(flat, mask)
        maybe = np.flatnonzero(block.bits[(own >> np.uint64(64 - _BITS)).astype(np.intp)])
        low, high = np.searchsorted(block.hashes, own[maybe], "left"), np.searchsorted(block.hashes, own[maybe], "right")
        hit = low < high
        places.append(maybe[hit])
        lows.append(low[hit])
        counts.append((high - low)[hit])
    if not sum(map(len, places)):
        return
    place, low, count = map(np.concatenate, (places, lows, counts))
    order = np.argsort(place, kind="stable")
    place, low, count = place[order], low[order], count[order]
    chunk = np.cumsum(count) // PAIRS
    edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(place)]
    for a, b in zip(edges, edges[1:], strict=False):
        c = count[a:b]
        entry = np.repeat(low[a:b] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        items, at = block.item_of[entry], np.repeat(place[a:b], c) - block.place_of[entry]
        order = np.lexsort((at, items))
        items, at = items[order], at[order]
        first = np.concatenate(([True], (np.diff(items) != 0) | (np.diff(at) != 0)))
        yield items[first], at[first]


def contained(block: Block, docs: list[np.ndarray], min_matches: int, min_share: float, min_identity: float, all_items: bool = True) -> list[dict[int, tuple[int, int, int]]]:
    """For each document, the positions in the block of the items that it contains, with matches, stretch and the word where the item is laid.

    Without all_items, one of them is enough.
    """
    flat = np.concatenate(docs) if docs else np.empty(0, np.uint64)
    ends = np.cumsum([len(x) for x in docs])
    lengths = np.array([len(x) for x in block.tokens], np.int64)
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
    for items, places in _laid(block, flat):
        # the documents that the laid item reaches into; a window that two share is told apart where the item stays within one
        firsts = np.searchsorted(ends, np.maximum(places, 0), "right")
        lasts = np.minimum(np.searchsorted(ends, np.minimum(places + lengths[items], len(flat)) - 1, "right"), len(docs) - 1)
        for item, at, first, last in zip(items.tolist(), places.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
            own = block.tokens[item]
            for d in range(first, last + 1):
                begin, end = int(ends[d]) - len(docs[d]), int(ends[d])
                a, b = max(at, begin), min(at + len(own), end)
                if b - a < min(min_matches, len(own)) or (out[d] and not all_items):
                    continue
                matches, length = best_stretch(own[a - at : b - at] == flat[a:b])
                if matches >= min(min_matches, len(own)) and matches >= min_share * len(own) and matches >= min_identity * length and (item not in out[d] or (matches, -length, -(a - begin)) > (out[d][item][0], -out[d][item][1], -out[d][item][2])):
                    out[d][item] = (matches, length, a - begin)
    return out


def blocks(benchmark: DataFrame, id_column: str, text_column: str, block_tokens: int) -> Iterator[Block]:
    """The benchmark's items in blocks of bounded size, a block at a time in the driver."""
    items: list[tuple[int | None, bytes]] = []
    size = 0
    for row in benchmark.select(F.col(id_column).cast("long"), F.col(text_column).cast("binary")).toLocalIterator(prefetchPartitions=False):
        text = bytes(row[1] or b"")
        n = len(text.translate(_LOWER).split())
        if items and size + n > block_tokens:
            yield block_of(items)
            items, size = [], 0
        items.append((row[0], text))
        size += n
    if items:
        yield block_of(items)


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matches", pa.int64()), ("stretch", pa.int64()), ("item_words", pa.int64()), ("first_word", pa.int64())])


def hits(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", block_tokens: int = BLOCK_TOKENS, **limits: float) -> DataFrame:
    """A row for each document and item that it contains: matches and words of the best stretch, the item's words, and the word of the document where the item begins."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    limits = DEFAULTS | limits

    def search(shared: Broadcast) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for part in parts_of(batch, 512):
                    found = contained(block, [tokens(x) for x in utf8(part.column(1))], **limits)
                    rows = [(i, block.items[k], *v[:2], len(block.tokens[k]), v[2]) for i, f in zip(part.column(0).to_pylist(), found, strict=True) for k, v in sorted(f.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], schema=HITS)

        return own.mapInArrow(run, "doc_id long, item_id long, matches long, stretch long, item_words long, first_word long")

    parts: list[DataFrame] = []
    waiting = None
    for block in blocks(benchmark, item_column, item_text_column, block_tokens):
        if waiting is not None:
            shared = spark.sparkContext.broadcast(waiting)  # of at most block_tokens tokens
            parts.append(materialise(search(shared), "hits"))
            shared.destroy()
        waiting = block
    parts.append(search(spark.sparkContext.broadcast(waiting if waiting is not None else block_of([]))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", block_tokens: int = BLOCK_TOKENS, **limits: float) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    ship(docs.sparkSession)
    limits = DEFAULTS | limits
    place, given, context = docs.columns.index(text_column), docs, docs.sparkSession.sparkContext

    def without(df: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for part in parts_of(batch, 512):
                    found = contained(block, [tokens(x) for x in utf8(part.column(place))], **limits, all_items=False)
                    yield part.filter(pa.array([not f for f in found], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    waiting = None
    for block in blocks(benchmark, item_column, item_text_column, block_tokens):
        if waiting is not None:
            shared, before = context.broadcast(waiting), docs
            docs = materialise(without(docs, shared), "clean")
            shared.destroy()
            if before is not given:
                release(before)
        waiting = block
    return docs if waiting is None else without(docs, context.broadcast(waiting))
