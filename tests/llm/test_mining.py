"""Secrets, phrases and whitening against brute force, and their odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import phrases, secrets, whitening

# -- secrets --------------------------------------------------------------------------------------


def base_of(text):
    """The contract's patterns, one by one, without any filter before them."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), m[2]))
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_patterns():
    rng = random.Random(4)
    parts = ["password", "PassWd", "token", "api_key", "APIKEY", "ſecret", "secret", "=", ": ", '"', "'", " ", "AKIA", "AKIA12AKIA", "0123456789abcdef", "a" * 5, "A1B2C3D4E5F6G7", "é", "-", ".", "deadbeef", "\n", "K", "_", "zz"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert secrets.base_spans(text) == base_of(text), text


KEY = "Zx9kQ2mVb7Lp4TnRc8WdYs"


def secret_docs():
    rng = random.Random(8)
    values = [f"{rng.getrandbits(80):020x}" for _ in range(12)] + [KEY, KEY[::-1], "EXAMPLEkey123456789abcZ", "Aa1" * 9]
    rows = []
    for i in range(160):
        owner = f"o{rng.randint(0, 5)}" if rng.random() < 0.9 else None
        text = " ".join(rng.choice([f"password={rng.choice(values)}", rng.choice(values), "plain words é", f"db://me:{rng.choice(values[12:])}@host/", f"-----BEGIN RSA PRIVATE KEY-----{rng.choice(values)}-----END RSA PRIVATE KEY-----", f"AKIA{'Q' * 16}"]) for _ in range(rng.randint(0, 5)))
        rows.append((i if i % 17 else None, text if i % 13 else None, None if owner is None else f"{owner}/r{rng.randint(0, 3)}"))
    own = lambda k: f"{KEY[k:]}{KEY[:k]}"
    rows += [(900, f"x://u:{own(3)}pw@h -----BEGIN PRIVATE KEY-----{own(5)}-----END PRIVATE KEY----- and {own(7)}", "o1/r1"), (901, f"password={own(9)} {own(9)}", "o2/r")]
    rows += [(7, f"mine {KEY[::2]}{KEY}", "o9/r"), (7, f"mine {KEY[::2]}{KEY}", "o9/r"), (8, "x" * 200_000 + " token: abcdefabcdef0011", "o9/r")]
    return rows


def test_ownership(spark):
    rows = secret_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'c' AS row", "'c' AS hash", "1 AS kind")
    every, owners, repositories = [], defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        base = base_of(text or "")
        own = base + secrets.added_spans(text or "", base)
        every.append((base, own))
        for *_, value in own:
            owners[value].add(source and source.split("/")[0])
            repositories[value].add(source)
    expected = []
    for (doc, _, _), (base, own) in zip(rows, every, strict=True):
        copied = {v: len(owners[v]) > 2 or len(repositories[v]) > 4 for *_, v in own}
        live = [x for x in own if secrets.looks_real(x[3]) and not copied[x[3]]]
        say = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, *_ in sorted(spans))
        expected.append((doc, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), say({*base, *live}), len(live), sum(copied[x[3]] for x in own)))
    found = [tuple(r) for r in secrets.find(docs).collect()]
    assert Counter(found) == Counter(expected)
    spans = ",".join(r[5] for r in found)
    assert "key:" in spans and "pem:" in spans and "url:" in spans and sum(r[7] for r in found) > sum(r[6] for r in found) > 0
    assert secrets.find(docs.limit(0)).count() == 0


def test_badly_encoded_secrets(spark):
    docs = spark.createDataFrame([(1, bytearray(b"\xff token=abcdefabcdef0011"), "s")], "doc_id long, raw binary, source string").select("doc_id", F.expr("cast(raw as string)").alias("text"), "source")
    assert [r.spans for r in secrets.find(docs).collect()] == ["assign:2:24,hex:8:24"]


# -- phrases --------------------------------------------------------------------------------------


def brute_phrases(rows, least, most_words, top, cover=50):
    out = []
    pieces = defaultdict(list)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            if words := re.findall(r"[^\x20\x09]+", piece):
                pieces["und" if lang is None else lang].append(tuple(words))
    for lang, own in pieces.items():
        f = Counter(w[i : i + k] for w in own for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
        n = sum(map(len, own))
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in some.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return out


def phrase_rows():
    rng = random.Random(6)
    words = ["a", "b", "c", "dé", "E", "f\x00g", "new", "york", "City", "\x1c"]
    rows = []
    for i in range(260):
        text = "".join(rng.choice([*words, "new york city", "hot dog"]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(rng.randint(0, 25)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text if i % 31 else None))
    return [*rows, ("en", "x y " * 400), ("en", "x y " * 400), ("de", ""), ("it", " \t.\n"), ("nl", "once only")]


@pytest.mark.parametrize("least, most_words, top, block_words", [(10, 3, 2000, 2_000_000), (4, 3, 15, 60), (3, 5, 500, 200), (5, 2, 9, 1)])
def test_phrases(spark, least, most_words, top, block_words):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, lang, text, 1, "c") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, name long, word string").repartition(3)
    found = [tuple(r) for r in phrases.collocations(docs, least, most_words, top=top, block_words=block_words).collect()]
    assert sorted(found) == sorted(brute_phrases(rows, least, most_words, top))


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    docs = spark.createDataFrame([("en", bytearray(b"\xff\xfe b, " * 12))], "lang string, raw binary").select("lang", F.expr("cast(raw as string)").alias("text"))
    assert [(r.phrase, r.a) for r in phrases.collocations(docs).collect()] == [("�� b", 12)]


# -- whitening ------------------------------------------------------------------------------------


def check_whitening(rows, found, width, most=4):
    fixed = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fixed})
    n, x = len(fit), np.array(fit)
    sums = x.sum(0)
    centred = (n * x - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    got = defaultdict(list)
    for r in found:
        got[r.vec_id].append(r)
    assert Counter(r.vec_id for r in found) == Counter({i: k * most for i, k in Counter(i for i, _ in fixed).items()})
    for i, own in fixed:
        for r in got[i]:
            j = r.component - 1
            assert r.n == n and int(r.deviation) == sum((n * a - int(s)) ** 2 for a, s in zip(own, sums, strict=True)) and abs(r.explained - e[j] / e.sum()) < 1e-9
            if e[j] > 1e-12 * e[0]:
                assert abs(abs(r.whitened) - abs(((n * np.array(own) - sums) / n) @ v[:, j] / np.sqrt(e[j]))) < 1e-6
            else:
                assert r.whitened is None
            assert r.identity_error < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [None, *rows[0][1][1:]]), (304, [float("nan"), *rows[0][1][1:]]), (305, [float("inf")] * 6), (306, []), (307, [1.0, 2.0]), (308, [-0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n").repartition(11)
    check_whitening(rows, whitening.whiten(vectors).collect(), 6)
    assert whitening.whiten(vectors.limit(0)).count() == 0


def test_whitening_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(200, 9)))]
    fit = whitening.fixed_point(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("x").distinct().repartition(13)
    x = np.array([r.x for r in fit.collect()])
    sums = x.sum(0).astype(object)
    r = whitening._triangles(fit, len(x), sums)
    centred = x - x.mean(0)
    assert r.shape == (9, 9) and np.allclose(r.T @ r, centred.T @ centred)


def test_whitening_of_few_rows(spark):
    """Fewer rows than entries, one row, rows that are all equal, entries past 64 bits."""
    few = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 5.0])]
    check_whitening(few, whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect(), 3, 3)
    for same in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]):
        found = whitening.whiten(spark.createDataFrame(same, "vec_id long, embedding array<double>")).collect()
        assert len(found) == 2 * len(same) and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in found)
    huge = [(1, [1e15, 0.0]), (2, [-1e15, 3.0]), (3, [5.0, 1e300])]
    found = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    big = np.iinfo(np.int64).max
    x = [[256 * 10**15, 0], [-256 * 10**15, 768], [1280, int(big)]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    own = {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x, 1)}
    assert {r.vec_id: r.deviation and int(r.deviation) for r in found} == {i: s if s < 10**38 else None for i, s in own.items()} and None in {r.deviation for r in found}


def test_jacobi_is_accurate():
    rng = np.random.default_rng(5)
    for rows, width in ((1, 1), (7, 7), (20, 8), (64, 64)):
        a = rng.normal(size=(rows, width)) * np.logspace(0, -10, width)
        r = np.linalg.qr(a, mode="r")
        v, lengths = whitening.jacobi(r)
        assert np.abs(v.T @ v - np.eye(width)).max() < 1e-13 and np.allclose(lengths, np.linalg.svd(a, compute_uv=False), rtol=1e-6, atol=1e-14)
        turned = a @ v
        assert np.abs(turned.T @ turned - np.diag(lengths**2)).max() < 1e-12 * lengths[0] ** 2
