"""Pre-tokens of a batch of texts in one rank queue."""

from __future__ import annotations

import random

from ledgerline.llm import bpe
from ledgerline.llm.common import tokenizer_path


def own_and_library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.encoder(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_a_batchs_new_pre_tokens_are_merged_together(monkeypatch):
    own, library = own_and_library()
    random.seed(4)
    texts = [" ".join("".join(random.choices("etaoinshrdléñ", k=random.randint(2, 20))) for _ in range(40)) for _ in range(50)]
    texts += ["", "  two\n\n " + texts[0], texts[1], "er" * 30 + " " + "a" * 64 + " \U0001f600中" * 20]
    one_by_one = []
    monkeypatch.setattr(own, "merge", lambda data, f=own.merge: one_by_one.append(data) or f(data))
    assert [list(map(int, x.split())) for x in own.spelled_texts(texts)] == [library.encode_ordinary(x) for x in texts]
    assert not [x for x in one_by_one if len(x.decode()) <= bpe.KEPT_CHARS]
    # what is kept gives the same
    assert [list(map(int, x.split())) for x in own.spelled_texts(texts[::-1])] == [library.encode_ordinary(x) for x in texts[::-1]]


def test_a_lower_rank_that_comes_up_goes_first():
    # "ab" makes "aba" possible, whose rank is lower than that of "ab" itself
    ranks = {bytes((b,)): b + 10 for b in range(256)} | {b"aba": 1, b"ab": 300, b"bc": 301, b"abc": 302}
    own = bpe.Encoder(ranks, ".+")
    words = [b"ababab", b"abcab", b"aabab", b"cbcabab", b"babbab"] + [bytes(random.Random(i).choices(b"abc", k=12)) for i in range(300)]
    assert list(own.merge_all(words)) == [own.merge(x) for x in words]
    assert not own.queue.buckets and not own.queue.top
