"""Token counts of whole texts by a public tokenizer's own library, lengths only.

Arrow functions take the texts in batches. Texts for the byte-level BPE are cut at safe
boundaries (`segments`), after the added tokens in them (as <|endoftext|>) are taken out, as the library does, so that only a very long run of letters is ever encoded at one go; pieces met before
have a kept length, and the others go to the library in batches balanced by bytes. Only
lengths leave the function. The word-level and sentencepiece models, whose tokens know
no such boundary, get whole texts, in batches balanced by bytes too.

Null and empty texts have no tokens. Bytes that aren't UTF-8 count as U+FFFD for tokens, as themselves for n_bytes. Repeated rows each give their row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_row, ship, texts_of, tokenizer_path
from ledgerline.llm.segments import all_pieces

#: Lengths of pieces that a Python worker keeps, in each of two generations.
KEPT_PIECES = 400_000
KEPT_CHARS = 64
#: Bytes that the library gets at once.
BATCH_BYTES = 1 << 17


def balanced(texts: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about as many bytes each; a longer text is a batch of its own."""
    batch: list[str] = []
    size = 0
    for x in texts:
        n = len(x) if x.isascii() else len(x.encode())
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(x)
        size += n + 8
    if batch:
        yield batch


class Counter:
    """The number of tokens of texts; lengths of pieces are kept."""

    def __init__(self, lengths: Callable[[list[str]], list[int]], cut: bool, added: Iterable[str] = ()) -> None:
        self.lengths, self.cut = lengths, cut
        # of added tokens that begin at one place the library takes the longest
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=lambda x: (-len(x), x))))) if added else None
        self.kept: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def of(self, texts: list[str]) -> list[int]:
        if not self.cut:
            out: list[int] = []
            for batch in balanced(texts):
                out += self.lengths(batch)
            return out
        if len(self.kept) > KEPT_PIECES:  # what was used since the last change of generations stays
            self.old, self.kept = self.kept, {}
        kept, old = self.kept, self.old
        cuts: list[list[str]] = []
        new: dict[str, None] = {}
        fixed = []
        for text in texts:
            parts = self.added.split(text) if self.added else [text]
            fixed.append(len(parts) - 1)  # an added token is one token
            own = all_pieces(text) if len(parts) == 1 else [x for part in parts for x in all_pieces(part)]
            cuts.append(own)
            for x in own:
                if x not in kept:
                    if x in old:
                        kept[x] = old[x]
                    else:
                        new[x] = None
        long: dict[str, int] = {}
        for batch in balanced(new):
            for x, n in zip(batch, self.lengths(batch), strict=True):
                (kept if len(x) <= KEPT_CHARS else long)[x] = n
        if long:
            both = {**kept, **long} if len(long) > 1000 else None
            take = both.__getitem__ if both else lambda x: long[x] if x in long else kept[x]
        else:
            take = kept.__getitem__
        return [n + sum(map(take, own)) for n, own in zip(fixed, cuts, strict=True)]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Counter(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], cut=False)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    with open(path, encoding="utf-8") as lines:
        spec = json.load(lines)
    return Counter(lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], cuttable(spec), [x["content"] for x in spec.get("added_tokens") or []])


def cuttable(spec: dict) -> bool:
    """Whether a tokenizer keeps every character and splits as byte-level BPE does, so that `segments` cuts are safe for it."""
    before = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or not x["content"] for x in added)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than limit) of every whole text; null counts as empty."""
    ship(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(columns: dict[str, pa.Array]) -> dict[str, list]:
        texts = [x or "" for x in texts_of(columns["text"])]
        n = counter(path).of(texts)
        size = columns["text"].cast(pa.binary())
        return {"doc_id": columns["doc_id"], "n_bytes": pc.fill_null(pc.binary_length(size), 0).cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(by_row(run, SCHEMA), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
