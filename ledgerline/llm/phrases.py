"""Collocations by hierarchical pair naming.

Texts become blocks: the words of many texts as a sequence of local codes, with a mark between pieces, and the block's own words. What
is counted over the corpus is a block's table of different items with their counts, never single occurrences, so a word or pair
that fills the corpus has at most one row for each block. Level 1's items are words. An item that occurs often enough in all blocks together
gets a name: the block and local code of its first row, which is the same in all blocks. Each block gets the names of its own frequent items
back, by a join on the block, and replaces its sequence: the items of the next level are the adjacent pairs of names, and a pair of
two (k-1)-word phrases that overlap in all but one word each is a k-word phrase. So a phrase's name points to its two parents, its first and its last
k-1 words: they hold the frequencies of all its cuts, and are the phrases that it may subsume.

Counts are exact; frequencies of parts of frequent phrases are all known, as a part is at least as frequent as the whole. A phrase within a longer
one is within one of its own length and a word, at least as frequent, so the look at its children is enough.

Null texts are empty. Null languages are `und`. Bytes that aren't UTF-8 count as U+FFFD. Repeated rows count each. A language without frequent phrases
has no rows, nor has an empty table. Ties are broken by the phrase, so ranks don't depend on the order of rows. A text is read whole, and a block ends after the text that
fills it: a task's memory is that of BLOCK_WORDS words and of the longest text. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import join_one, materialise, parts_of, release, ship, texts_of

#: Words in a block, about.
BLOCK_WORDS = 2_000_000
#: Bits of a name that hold the local code, and above them those that hold a block's number in its task; the task's is above both.
CODE_BITS, TASK_BITS = 28, 14
#: Parts in which a language's best phrases are sought before they meet.
DEALS = 64

_MARK = b"\xff"  # stands in no UTF-8 text; between pieces
_SPLIT = bytes(0xFF if chr(i) in ".,;:!?\n\x0b\x0c\r" else 0x20 if i == 9 else i for i in range(256))


def tokens(text: str) -> list[bytes]:
    """The words of a text, lower-cased in A-Z, with a mark at the end of each piece."""
    data = text.encode("utf-8", "replace").translate(_SPLIT).lower()
    return (data.replace(_MARK, b" \xff ") + b" \xff").split()


def packed(codes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(codes.astype(np.int32).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32)


class Block:
    """The words of texts that a task reads in a row. Equal words of different languages have codes of their own."""

    def __init__(self) -> None:
        self.next = count(1).__next__
        self.codes: dict[str, defaultdict[bytes, int]] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        if lang not in self.codes:
            self.codes[lang] = defaultdict(self.next, {_MARK: 0})
        own = tokens(text)
        self.parts.append(np.fromiter(map(self.codes[lang].__getitem__, own), np.int32, len(own)))
        self.size += len(own)

    def row(self, number: int) -> dict[str, object]:
        sequence = np.concatenate(self.parts)
        known = sorted((code, lang, word) for lang, own in self.codes.items() for word, code in own.items() if code)
        counts = np.bincount(sequence, minlength=len(known) + 1)[1:]
        return {"block": number, "seq": packed(sequence), "langs": [lang for _, lang, _ in known], "words": [word.decode() for _, _, word in known], "counts": counts}


_BLOCKS = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_ITEMS = pa.schema([("at", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("c", pa.int64())])
_NAMED = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("names", pa.binary())])


def blocks(docs: DataFrame, lang_column: str, text_column: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, seq, and its words, their languages and counts; the blocks' numbers hold only once the table is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = Block(), TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            for part in parts_of(batch):
                for lang, text in zip(texts_of(part.column(0)), texts_of(part.column(1)), strict=True):
                    if text:
                        own.add("und" if lang is None else lang, text)
                        if own.size >= block_words:
                            yield pa.RecordBatch.from_pylist([own.row(number)], schema=_BLOCKS)
                            own, number = Block(), number + 1
        if own.size:
            yield pa.RecordBatch.from_pylist([own.row(number)], schema=_BLOCKS)

    return docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).mapInArrow(run, "block long, seq binary, langs array<string>, words array<string>, counts array<long>")


def pairs(sequence: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of codes from 1 to width, 0 for none: the adjacent pairs as left codes, right codes and counts, where they stand, and which is there."""
    left, right = sequence[:-1].astype(np.int64), sequence[1:].astype(np.int64)
    where = np.flatnonzero((left > 0) & (right > 0))
    different, which, counts = np.unique(left[where] * (width + 1) + right[where], return_inverse=True, return_counts=True)
    return different // (width + 1), different % (width + 1), counts, where, which


def items(state: DataFrame) -> DataFrame:
    """at (the block and a local code), l, r (names) and c of each block's different adjacent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, seq, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                known = np.frombuffer(names, np.int64)
                left, right, counts, _, _ = pairs(unpacked(seq), len(known))
                at = (block << CODE_BITS) + np.arange(len(left))
                for i in range(0, len(left), 100_000):
                    k = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(at[k]), pa.array(known[left[k] - 1]), pa.array(known[right[k] - 1]), pa.array(counts[k])], schema=_ITEMS)

    return state.select("block", "seq", "names").mapInArrow(run, "at long, l long, r long, c long")


def named(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The blocks' items (at, keys, c) that occur `least` times in all, with f, their frequency, and name, the same in all blocks. An item has at most one row for each block."""
    own = Window.partitionBy(*keys)
    return counted.select("at", *keys, F.sum("c").over(own).alias("f"), F.min("at").over(own).alias("name")).where(F.col("f") >= least)


def renamed(state: DataFrame, frequent: DataFrame, first: bool) -> DataFrame:
    """The blocks' next sequences: local codes of their frequent items, and the items' names. first: the items are words, not pairs."""
    given = frequent.select(F.shiftright("at", CODE_BITS).alias("block"), F.col("at").bitwiseAND((1 << CODE_BITS) - 1).cast("int").alias("code"), "name")

    def run(own: pa.Table, names: pa.Table) -> pa.Table:
        if not own.num_rows or not names.num_rows:
            return _NAMED.empty_table()
        sequence = unpacked(own.column("seq")[0].as_py())
        code = names.column("code").to_numpy()
        order = np.argsort(code)
        code, name = code[order], names.column("name").to_numpy()[order]
        if first:  # code 1 is the first word's
            new = np.zeros(int(sequence.max(initial=0)) + 1, np.int32)
            new[code + 1] = np.arange(1, len(code) + 1)
            out = new[sequence]
        else:
            left, _, _, where, which = pairs(sequence, len(own.column("names")[0].as_py()) // 8)
            new = np.zeros(len(left), np.int32)
            new[code] = np.arange(1, len(code) + 1)
            out = np.zeros(max(0, len(sequence) - 1), np.int32)
            out[where] = new[which]
        return pa.table([own.column("block"), pa.array([packed(out)]), pa.array([name.astype(np.int64).tobytes()])], schema=_NAMED)

    columns = ["block", "seq"] if first else ["block", "seq", "names"]
    return state.select(*columns).groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, "block long, seq binary, names binary")


def _whole(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("decimal(38,0)")


def candidates(docs: DataFrame, least: int = 10, most_words: int = 3, lang_column: str = "lang", text_column: str = "text", block_words: int = BLOCK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """(levels, sizes): for each number of words the frequent phrases: name, its parents l and r, lang, phrase, a, and the frequencies of its first and of its last 1, 2, ... words; and n by lang.

    The tables are written in the shared folder.
    """
    ship(docs.sparkSession)
    state = materialise(blocks(docs, lang_column, text_column, block_words), "blocks")
    at = F.shiftleft("block", CODE_BITS) + F.col("pos")
    words = state.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("pos", "w")).select(at.alias("at"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    sizes = materialise(words.groupBy("lang").agg(F.sum("c").alias("n")), "sizes")
    frequent = materialise(named(words, ["lang", "word"], least), "words")
    one = frequent.where(F.col("name") == F.col("at")).select("name", "lang", F.col("word").alias("phrase"), "word", F.col("f").alias("a"), F.array("f").alias("firsts"), F.array("f").alias("lasts"))
    levels = [materialise(one, "level")]
    for k in range(2, most_words + 1):
        new = materialise(renamed(state, frequent, k == 2), "sequences")
        release(state, frequent)
        state = new
        counted = items(state)
        if k < most_words:
            frequent = materialise(named(counted, ["l", "r"], least), "pairs")
            found = frequent.where(F.col("name") == F.col("at")).select("name", "l", "r", F.col("f").alias("a"))
        else:
            found = materialise(counted.groupBy("l", "r").agg(F.sum("c").alias("a"), F.min("at").alias("name")).where(F.col("a") >= least), "pairs")
        below = levels[-1]
        left = below.select(F.col("name").alias("l"), "lang", F.col("phrase").alias("start"), "firsts")
        right = below.select(F.col("name").alias("r"), "word", "lasts")
        both = join_one(materialise(join_one(found, left, "l"), "halves"), right, "r")
        levels.append(materialise(both.select("name", "l", "r", "lang", F.concat_ws(" ", "start", "word").alias("phrase"), "word", "a", F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts")), "level"))
        if k == most_words:
            release(found)
    release(state)
    return levels, sizes


def collocations(docs: DataFrame, least: int = 10, most_words: int = 3, cover: int = 50, top: int = 2000, lang_column: str = "lang", text_column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each language's `top` phrases of two to most_words words: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the lowest of floor(1000000 * a * a / (l * r)) over its cuts in two parts, the shortest first part on ties. Phrases
    within a longer one of at least `cover` per cent of their frequency go.
    """
    levels, sizes = candidates(docs, least, most_words, lang_column, text_column, block_words)
    million = F.lit(1_000_000).cast("decimal(7,0)")
    scored = []
    for k in range(2, most_words + 1):
        own = levels[k - 1]
        if k < most_words:
            inside = levels[k].select(F.col("l").alias("name"), F.col("a").alias("longer")).unionByName(levels[k].select(F.col("r").alias("name"), F.col("a").alias("longer")))
            longest = inside.groupBy("name").agg(F.max("longer").alias("longer"))
            own = own.join(longest, "name", "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))
        cuts = [(F.element_at("firsts", i), F.element_at("lasts", k - i)) for i in range(1, k)]
        whole = million * _whole("a") * _whole("a")
        each = [F.struct(F.call_function("div", whole, _whole(x) * _whole(y)).alias("score"), F.lit(i).alias("cut"), x.alias("l"), y.alias("r")) for i, (x, y) in enumerate(cuts, 1)]
        scored.append(own.select("lang", "phrase", "a", F.array_min(F.array(*each)).alias("best")))
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    flat = every.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(DEALS))
    some = flat.withColumn("_deal", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # from DEALS * top rows of a language at most
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
