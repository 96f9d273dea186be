"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of a pre-token are chosen with a priority queue whose keys are merge ranks, a
bounded set of integers. Each rank has a bucket of the positions where its pair stands, and a
bitmap in levels of 256-bit words tells which buckets have positions: find-first-set on one
word of each level gives the lowest rank. Symbols are a doubly linked list over byte
positions, so a merge costs a constant number of steps. Positions whose pair has changed
since they were queued are stale and skipped. An n-byte pre-token takes O(n log n) steps at
most, for any n.

The short pre-tokens that a batch of texts brings stand side by side in one such queue. None's merges depend on another's,
so the leftmost positions that a bucket has of each are merged at once, as arrays.

Null and empty texts have no tokens. Bytes that aren't UTF-8 count as U+FFFD. Repeated rows each give their row. Columns other than
the id and the text don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_row, ship, texts_of, tokenizer_path
from ledgerline.llm.segments import plain_pieces, whole_pieces

#: Encoded pieces and pre-tokens that a Python worker keeps, in each of two generations.
KEPT_PIECES = 300_000
KEPT_TOKENS = 500_000
#: Longer ones aren't kept.
KEPT_CHARS = 64
#: Rows of a batch of digests, bytes of pre-tokens that share a queue, and pre-tokens from which on that takes less time than one by one.
BATCH_ROWS, QUEUE_BYTES, FEW = 4096, 1 << 20, 500


_BIT = [1 << i for i in range(256)]


class RankQueue:
    """Buckets of positions by rank, with a bitmap in two levels of 256-bit words over the ranks that have positions."""

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * ((n_ranks + 255) >> 8)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.mark(rank)
        else:
            heappush(bucket, position)

    def mark(self, rank: int) -> None:
        self.low[rank >> 8] |= _BIT[rank & 255]
        self.top |= 1 << (rank >> 8)

    def unmark(self, rank: int) -> None:
        self.low[rank >> 8] ^= _BIT[rank & 255]
        if not self.low[rank >> 8]:
            self.top ^= 1 << (rank >> 8)

    def lowest(self) -> int:
        """The lowest rank with a position; only while top isn't 0."""
        word = (self.top & -self.top).bit_length() - 1
        x = self.low[word]
        return (word << 8) + (x & -x).bit_length() - 1

    def pop(self) -> tuple[int, int]:
        """The lowest rank with a position, and its leftmost position; only while top isn't 0."""
        rank = self.lowest()
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.unmark(rank)
        return rank, bucket[0]


class Kept:
    """Results by text in two generations: what was used since the last change of generations outlives the next."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def get(self, key: str) -> str | None:
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: str) -> None:
        self.new[key] = value
        if len(self.new) > self.most:
            self.old = self.new.copy()
            self.new.clear()  # callers hold on to new


class Encoder:
    """Ranks of byte strings, and what splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte_pairs = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        self.n_ranks = max(ranks.values(), default=0) + 1
        self.queue = RankQueue(self.n_ranks)
        self.byte_ranks = np.array([ranks.get(bytes((a,)), -1) for a in range(256)], np.int64)
        both = sorted((ranks[piece[:k]] * self.n_ranks + ranks[piece[k:]], rank) for piece, rank in ranks.items() for k in range(1, len(piece)) if piece[:k] in ranks and piece[k:] in ranks)
        self.pair_keys, self.pair_ranks = np.array([(-1, -1), *both], np.int64).T.copy()  # the first stands before all keys
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.spelled_byte = {str(rank): piece for piece, rank in ranks.items()}
        self.pieces, self.after_blank, self.tokens = Kept(KEPT_PIECES), Kept(KEPT_PIECES), Kept(KEPT_TOKENS)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token. The queue's push and pop are written out: calls would cost a quarter more time."""
        ranks = self.ranks
        get = ranks.get
        whole = get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        end = list(range(1, n + 1))  # where the symbol that starts here ends, and so the next starts; 0: no symbol starts here
        before = list(range(-1, n - 1))
        low, buckets, top, pairs = self.queue.low, self.queue.buckets, 0, self.byte_pairs
        first = data[0]
        for i in range(1, n):
            second = data[i]
            pair = pairs[first << 8 | second]
            if pair is not None:
                if pair in buckets:
                    heappush(buckets[pair], i - 1)
                else:
                    buckets[pair] = [i - 1]
                    low[pair >> 8] |= _BIT[pair & 255]
                    top |= 1 << (pair >> 8)
            first = second
        while top:
            word = (top & -top).bit_length() - 1
            x = low[word]
            rank = (word << 8) + (x & -x).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = x = x & (x - 1)
                if not x:
                    top &= top - 1
            middle = end[i]
            if not middle or middle >= n:
                continue  # stale
            stop = end[middle]
            if get(data[i:stop]) != rank:
                continue  # stale
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
            left = before[i]
            for at, pair in ((i, get(data[i : end[stop]]) if stop < n else None), (left, get(data[left:stop]) if left >= 0 else None)):
                if pair is not None:
                    if pair in buckets:
                        heappush(buckets[pair], at)
                    else:
                        buckets[pair] = [at]
                        low[pair >> 8] |= _BIT[pair & 255]
                        top |= 1 << (pair >> 8)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def merge_all(self, tokens: list[bytes]) -> Iterator[list[int]]:
        """The ids of pre-tokens, none of them empty or in ranks. A bucket that has several positions of one is popped once for each, so they should be short."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes)
        starts, n = ends - sizes, int(ends[-1])
        token = np.append(np.repeat(np.arange(len(tokens)), sizes), -1)
        symbols = np.append(self.byte_ranks[np.frombuffer(b"".join(tokens), np.uint8)], -1)
        end = np.arange(1, n + 1)  # where the symbol that starts here ends, and so the next starts; 0: no symbol starts here
        before = np.arange(-1, n)
        before[starts] = -1
        pairs = np.full(n, -1)  # the rank of the symbol that starts here with the next; -1: none
        queue, buckets = self.queue, self.queue.buckets

        def push(at: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
            """Queue positions by the rank of the symbols at them and after them."""
            keys = np.where((first < 0) | (second < 0), -1, first * self.n_ranks + second)
            found = np.searchsorted(self.pair_keys, keys, "right") - 1
            ranks = np.where(self.pair_keys[found] == keys, self.pair_ranks[found], -1)
            pairs[at] = ranks
            known = ranks >= 0
            at, ranks = at[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()] if len(at) else [], [*cuts.tolist(), len(at)], strict=False):
                rank = int(ranks[i])
                if rank in buckets:
                    buckets[rank].append(at[i:j])
                else:
                    buckets[rank] = [at[i:j]]
                    queue.mark(rank)

        inner = np.flatnonzero(token[:-1] == token[1:])
        push(inner, symbols[inner], symbols[inner + 1])
        while queue.top:
            rank = queue.lowest()
            at = np.concatenate(buckets.pop(rank))
            at = at[pairs[at] == rank]  # others are stale
            at.sort()
            own = token[at]
            later = np.flatnonzero(own[1:] == own[:-1]) + 1
            if len(later):
                buckets[rank] = [at[later]]  # they come after what this merge brings, if that is lower
                at = np.delete(at, later)
            else:
                queue.unmark(rank)
            if not len(at):
                continue
            middle = end[at]
            stop = end[middle]
            end[at], end[middle], pairs[at], pairs[middle], symbols[at] = stop, 0, -1, -1, rank
            inside = token[stop] == token[at]
            here, after, left = at[inside], stop[inside], before[at]
            before[after] = here
            left = left[left >= 0]
            of_rank = np.full(len(here) + len(left), rank)
            push(np.concatenate((here, left)), np.concatenate((of_rank[: len(here)], symbols[left])), np.concatenate((symbols[after], of_rank[len(here) :])))
        alive = end != 0
        ids = symbols[:-1][alive].tolist()
        if -1 in ids:
            raise KeyError("a byte without a rank")
        to = np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64)).tolist()
        return (ids[i:j] for i, j in zip([0, *to], to, strict=False))

    def learn(self, tokens: list[str]) -> None:
        """Keep the decimal ids of short pre-tokens."""
        data = [x.encode() for x in tokens]
        own = [i for i, x in enumerate(data) if x not in self.ranks]
        out = [self.names.get(self.ranks.get(x)) for x in data]
        name = self.names.__getitem__
        start = size = 0
        for k, i in enumerate(own):
            size += len(data[i])
            if size >= QUEUE_BYTES or k + 1 == len(own):
                some = own[start : k + 1]
                found = self.merge_all([data[j] for j in some]) if len(some) >= FEW else (self.merge(data[j]) for j in some)
                for j, ids in zip(some, found, strict=True):
                    out[j] = " ".join(map(name, ids))
                start, size = k + 1, 0
        for x, ids in zip(tokens, out, strict=True):
            self.tokens.put(x, ids)

    def spelled_token(self, token: str) -> str:
        """The decimal ids of a pre-token, joined by one space."""
        found = self.tokens.new.get(token) or self.tokens.get(token)
        if found is None:
            found = " ".join(map(str, self.merge(token.encode())))
            if len(token) <= KEPT_CHARS:
                self.tokens.put(token, found)
        return found

    def spelled_text(self, text: str) -> str:
        """The decimal ids of a whole text, joined by one space."""
        return self.spelled_texts([text])[0]

    def spelled_texts(self, texts: list[str]) -> list[str]:
        """The decimal ids of each whole text, joined by one space. Pre-tokens that aren't kept yet are merged together."""
        runs = []  # of a text's pieces, those found before, what keeps them and the blank before them
        for text in texts:
            own = plain_pieces(text) if text else []
            if own is None:
                own, head = whole_pieces(text), None
            else:
                head = own[:1]
            rest = own[len(head) :] if head else own
            runs.append([(x, list(map(kept.new.get, x)), kept, blank) for x, kept, blank in ((head, self.pieces, ""), (rest, self.pieces if head is None else self.after_blank, "" if head is None else " ")) if x])
        new: dict[str, dict[str, str | int]] = {"": {}, " ": {}}  # by blank, the ids of each piece that isn't in the new generation, or its number among those cut into pre-tokens
        tokens: list[str] = []
        cuts = [0]
        for x, out, kept, blank in (y for own in runs for y in own):
            if None in out:
                some = new[blank]
                for piece in [piece for piece, found in zip(x, out, strict=True) if found is None]:
                    if piece not in some:
                        found = kept.get(piece)
                        if found is None:
                            found = len(cuts) - 1
                            tokens += self.find(blank + piece)
                            cuts.append(len(tokens))
                        some[piece] = found
        self.learn([x for x in dict.fromkeys(tokens) if len(x) <= KEPT_CHARS and x not in self.tokens.new and self.tokens.get(x) is None])
        tokens = list(map(self.spelled_token, tokens))
        for blank, kept in (("", self.pieces), (" ", self.after_blank)):
            some = new[blank]
            for piece, found in some.items():
                if isinstance(found, int):
                    some[piece] = found = " ".join(tokens[cuts[found] : cuts[found + 1]])
                    if len(piece) <= KEPT_CHARS:
                        kept.put(piece, found)
        lines = []
        for own in runs:
            for x, out, _, blank in own:
                if None in out:
                    some = new[blank]
                    out[:] = [some[piece] if found is None else found for piece, found in zip(x, out, strict=True)]
            lines.append(" ".join([" ".join(out) for _, out, _, _ in own]))
        return lines

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.spelled_text(text).split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return Encoder(ranks, pattern)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the bytes that the ids stand for) of every whole text; null counts as empty."""
    ship(docs.sparkSession)
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(columns: dict[str, pa.Array]) -> dict[str, list]:
        own = encoder(path, pattern)
        ids = [list(map(int, x.split())) for x in own.spelled_texts([x or "" for x in texts_of(columns["text"])])]
        return {"doc_id": columns["doc_id"], "n_tokens": [len(x) for x in ids], "ids": ids, "decoded": [own.decode(x) for x in ids]}

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(by_row(run, SCHEMA), "doc_id long, n_tokens long, ids array<int>, decoded binary")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As encode_documents, with SHA-256 of the ids (in decimal, joined by one space) and of the decoded bytes in place of both."""
    ship(docs.sparkSession)
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(columns: dict[str, pa.Array]) -> dict[str, list]:
        own = encoder(path, pattern)
        n, spelled, decoded = [], [], []
        names = own.spelled_byte
        for line in own.spelled_texts([x or "" for x in texts_of(columns["text"])]):
            ids = line.split()
            n.append(len(ids))
            spelled.append(hashlib.sha256(line.encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(names.__getitem__, ids))).hexdigest())
        return {"doc_id": columns["doc_id"], "n_tokens": n, "ids_sha256": spelled, "decoded_sha256": decoded}

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(by_row(run, DIGEST, BATCH_ROWS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
