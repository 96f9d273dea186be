"""The training-data operators against brute force, exact round trips and held-out accuracy, and their odd inputs."""

import base64
import hashlib
import io
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bpe, common, components, decontamination, divergence, main_text, near_duplicates, packing, personal_data, segments, sharding, token_counts, warc
from ledgerline.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TRAINING = {"steps": 700}


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x" * 50_000), (None, "a b c d e f"), (5, long), (6, "naïve 😀 text here")]
    return spark.createDataFrame([(i, t, None, "k", "r", "c", 1) for i, t in rows], "doc_id long, text string, lang string, set_key string, rep string, chunk string, n long")


# -- near-duplicates ----------------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute_components(texts, threshold=85):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts():
    random.seed(5)
    words = [f"w{i}" for i in range(500)]
    base = [random.choices(words, k=random.choice([3, 4, 60, 150, 300])) for _ in range(25)]
    out = [" ".join(b) for b in base]
    for b in base:
        for edits in (0, 1, 2, 4, 8):
            c = list(b)
            for _ in range(edits):
                c[random.randrange(len(c))] = random.choice(words)
            out.append(" ".join(c).upper() if edits == 0 else " ".join(c))
    random.shuffle(out)
    return [*out, None, "", " "]


@pytest.mark.parametrize("group_shingles, threshold", [(near_duplicates.GROUP_SHINGLES, 85), (700, 80)])
def test_near_duplicates(spark, group_shingles, threshold):
    texts = near_texts()
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(table(spark, texts), threshold=threshold, group_shingles=group_shingles).collect()}
    assert found == {i: (n, c, c == i) for i, (n, c) in enumerate(brute_components(texts, threshold))}


def test_near_duplicates_of_odd_rows(spark, odd):
    found = near_duplicates.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in found}
    assert by[0, 0] == (0, True) and by[3, 2] == (3, True) and by[None, 2] == (None, True) and by[5, 977][0] == 5
    assert near_duplicates.near_duplicates(odd.limit(0)).collect() == []
    left = near_duplicates.keep_one(odd.withColumn("number", F.lit(1)).withColumn("row", F.lit("clash")))
    assert left.columns == [*odd.columns, "number", "row"]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((r.doc_id, r.text) for r in odd.dropDuplicates().where("doc_id is not null").collect())


def test_hubs_are_dealt(spark, tmp_path):
    rows = [(i, 1 if i % 3 else i) for i in range(6000)] + [(i, None) for i in range(6000, 6500)]
    spark.createDataFrame(rows, "i long, k long").write.parquet(str(tmp_path / "rows"))
    one = spark.createDataFrame([(i, -i) for i in range(0, 6000, 2)] + [(1, -1)], "k long, x long")
    rows_df = spark.read.parquet(str(tmp_path / "rows"))
    for how in ("inner", "left"):
        joined = common.join_one(rows_df, one, "k", how)
        assert Counter(joined.select("i", "k", "x").collect()) == Counter(rows_df.join(one, "k", how).select("i", "k", "x").collect())


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 3000):
        assert (near_duplicates.sketch(rng.integers(0, 2**63, n).astype(np.uint64)) != near_duplicates._EMPTY).all()
    pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = near_duplicates.sketch(pool[:1000]), near_duplicates.sketch(pool[200:])
    assert abs((a == b).mean() - 800 / 1200) < 0.15


def test_spanning_links_are_a_forest():
    random.seed(2)
    sets = [np.unique(np.array(random.sample(range(60), 40) if i % 3 else list(range(40 + i % 2)), np.uint64)) for i in range(40)]
    links = near_duplicates.spanning_links(sets)
    true = {(a, b) for a, b in itertools.combinations(range(40), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert all((min(x), max(x)) in true for x in links)

    def parts(edges):
        root = list(range(40))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(i for i in range(40) if find(i) == find(j)) for j in range(40)}

    assert parts(links) == parts(true) and len(links) == 40 - len(parts(true))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (5, 4)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- tokens -------------------------------------------------------------------------------------


def odd_strings():
    random.seed(9)
    chars = " \n\t\r\x0b\x0c\x1c\x85\xa0　ab's1٣.!😀中"
    return ["".join(random.choices(chars, k=random.randint(0, 14))) for _ in range(4000)] + ["a" * 3000, "", "it's 12 o'clock<|endoftext|> now"]


def test_bpe_is_the_librarys():
    import public_tokenizers
    import tiktoken

    own = bpe.encoder(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for x in odd_strings():
        ids = own.encode(x)
        assert ids == library.encode_ordinary(x) and own.decode(ids) == x.encode()
    random.seed(1)
    long = "".join(random.choices("abcdefgh", k=30_000))
    assert own.merge(long.encode()) == library.encode_ordinary(long)


def test_bpe_queries(spark, odd):
    rows = bpe.encode_documents(odd).collect()
    assert len(rows) == odd.count() and all(len(r.ids) == r.n_tokens for r in rows)
    texts = Counter(r.text or "" for r in odd.collect())
    assert Counter(bytes(r.decoded).decode() for r in rows) == texts
    digests = {r.doc_id: r for r in bpe.encode_digests(odd).collect()}
    for r in rows:
        if r.doc_id is not None:
            assert digests[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.encode_digests(odd.limit(0)).count() == 0


def test_rank_queue():
    random.seed(3)
    queue, expected = bpe.RankQueue(5000), []
    for _ in range(3000):
        if expected and random.random() < 0.45:
            assert queue.pop() == min(expected)
            expected.remove(min(expected))
        else:
            x = (random.choice([0, 63, 64, 4095, 4096, random.randrange(5000)]), random.randrange(50))
            queue.push(*x)
            expected.append(x)


def test_segments_join_again():
    for x in odd_strings():
        assert "".join(segments.all_pieces(x)) == x


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, name):
    path = tokenizer_path(name)
    texts = odd_strings()[-600:]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(model.encode(x)) for x in texts]
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        expected = [len(model.encode(x, add_special_tokens=False).ids) for x in texts]
    assert token_counts.counter(path).of(texts) == expected
    found = {r.doc_id: r for r in token_counts.count_tokens(odd, path=path).collect()}
    assert found[0].n_tokens == found[0].n_bytes == 0 and found[5].over_limit and found[6].n_bytes == len("naïve 😀 text here".encode())


# -- packing ------------------------------------------------------------------------------------


def test_best_fit_decreasing():
    random.seed(1)
    for _ in range(100):
        capacity = random.choice([1, 2, 7, 16, 33])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 40))]
        rows = packing.best_fit_decreasing(lengths, capacity)
        room = []
        for n in sorted(lengths, reverse=True):
            fit = [i for i, r in enumerate(room) if r >= n]
            if fit:
                room[min(fit, key=room.__getitem__)] -= n
            else:
                room.append(capacity - n)
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(room)
        assert sorted(itertools.chain(*rows)) == list(range(len(lengths)))


def test_packing_loses_nothing(spark, odd, tmp_path):
    packing.write(packing.pack(odd, capacity=64, group_tokens=5000), str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    matrix = packing.matrix([bytes(r.ids) for r in rows], 64)
    found = {}
    for row, r in zip(matrix, rows, strict=True):
        assert r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1]
        positions = packing.position_ids(r.cu_seqlens, 64)
        for a, b, doc, piece in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces, strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            found.setdefault((doc, piece), []).append(row[a:b].tolist())
    encode, highest = packing.tiktoken_encoder(tokenizer_path("byte_bpe_50k.tiktoken"), bpe.default_pattern())
    assert highest < 50_256
    for doc, text in {(r.doc_id, r.text) for r in odd.collect()}:
        pieces = sorted(p for d, p in found if d == doc)
        assert sum((found[doc, p][0] for p in pieces), []) == [*encode(text or ""), 50256]
    assert len(found[3, 0]) == 2  # a repeated row
    assert packing.pack(odd.limit(0)).count() == 0


# -- archives -----------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [(i, None if i % 7 == 0 else f"http://h/{i}\n", [None, "", "<p>a</p>", f"<p>{i} é</p>" * 50][i % 4]) for i in range(60)] + [(None, "u", "<p>a</p>"), (3, "u", "zz")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, archive_bytes=700).collect()]
    best = {}
    for i, _, h in rows:
        best[h or ""] = max([x for x in (best.get(h or ""), i) if x is not None], default=None)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        of = best[h or ""]
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if of == i else "revisit", None if of == i else of))
    assert Counter(found) == Counter(expected)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.round_trip(pages, least_bytes=3).collect()} == {1: None, 2: None, 3: 4, 4: None}


def archive(records):
    out = io.BytesIO()
    warc.write_archive(out, iter(records))
    return out.getvalue()


def test_archives_are_checked():
    records = [warc.record(i, "u", b"<p>x</p>" * i, warc.digest(b"<p>x</p>" * i), None) for i in range(40)]
    data = archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.read_archive(io.BytesIO(data), chunk=13)) == records
    assert warc.parsed(records[3], "r")["payload"] == b"<p>x</p>" * 3
    for broken in (data[:-3], data[:5], data[:200] + b"junk" + data[200:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(broken)))
    for broken in (records[3][:-1], records[3].replace(b"Content-Length: ", b"Content-Length: 1", 1), records[3].replace(b"<p>x", b"<p>y", 1), records[3][4:], records[3].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.parsed(broken, "r")


# -- sharding -----------------------------------------------------------------------------------


def test_sharding(spark):
    random.seed(8)
    texts = [f"t{random.randrange(1500)}" for _ in range(900)] + ["hot"] * 300 + [None, None, ""]
    rows = sharding.shard(table(spark, texts), n_shards=6).collect()
    assert len(rows) == len(texts)
    import zlib

    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(6)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    shards = spark.createDataFrame([(r.doc_id, r.gid, r.shard) for r in rows], "doc_id long, gid binary, shard int")
    links, cut = sharding.cut(shards.where("doc_id < 900")).first()
    assert cut <= 0.1 * links
    assert sum(n for _, n in Counter(r.shard for r in rows if texts[r.doc_id] == "hot").most_common(3)) >= 0.85 * 300


def test_sharding_of_few_rows(spark, odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count() and max(Counter(r.shard for r in rows).values()) == 1
    assert sharding.shard(odd.limit(0)).count() == 0


# -- quality ------------------------------------------------------------------------------------


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def test_base_counts(spark, odd):
    random.seed(6)
    texts = ["".join(random.choices(["a ", "b ", "é\n", "İ ", "c\t", "\n", "#x ", " ", "\x0b", "|"], k=random.randint(0, 150))) for _ in range(150)] + [" ".join(["the", "of"][i % 2] if i % 3 else f"w{i}" for i in range(90_000)), "a a a a", None, ""]
    found = {r.doc_id: r for r in divergence.quality(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(text), i
        assert not (r.kept and r.base_failed)
    assert len(divergence.quality(odd).collect()) == odd.count() and divergence.quality(odd.limit(0)).count() == 0


def test_divergence_rejects_odd_distributions(spark):
    random.seed(2)
    words = ["the", "of", "and", "to", "in"] + [f"{a}{b}" for a in ("thing", "stor", "land", "water") for b in ("ing", "ed", "er", "s", "ly")]
    clean = [" ".join(random.choices(words, k=120)) for _ in range(200)]
    junk = [" ".join(w + "%%%" for w in clean[0].split()), " ".join(w for w in clean[1].split() if len(w) > 4).replace(" ", " | ") * 2, clean[2].upper()]
    found = {r.doc_id: r.kept for r in divergence.quality(table(spark, clean + junk)).collect()}
    assert all(found[i] for i in range(200)) and not any(found[200 + i] for i in range(3))


# -- personal data ------------------------------------------------------------------------------


def plain_base(text):
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 12 <= len(digits) <= 19 and personal_data.luhn(digits)) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    random.seed(7)
    chars = "ab@.+-12 34()5é6789,0\n%_"
    texts = ["".join(random.choices(chars, k=random.randint(0, 60))) for _ in range(20_000)] + ["a@b.c@d.e x.y@1-.a..b", "4111 1111 1111 1111", "+1 (017) 555-7713", "1.2.3.4.5.6.7.8 256.1.1.1"]
    for x in texts:
        assert personal_data.base_spans(x) == plain_base(x), x


def test_tagger_on_held_out_text():
    w = personal_data.trained(**TRAINING)
    maker = personal_data._Maker(999)
    samples = [maker.sample(400, 0.06) for _ in range(150)]
    scores, first, filled = personal_data.text_scores(w, [x for x, _ in samples])
    found = set(personal_data.decode(w, scores, filled))
    gold = set()
    for start, (_, tags) in zip(first.tolist(), samples, strict=True):
        cuts = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
        gold |= {(start + a, int(tags[a]) - 1, start + b) for a, b in zip(cuts, cuts[1:], strict=False) if tags[a]}
    assert len(found & gold) / len(found) > 0.9 and len(found & gold) / len(gold) > 0.9
    whole = sorted(x for s, (t, _) in zip(first.tolist(), samples, strict=True) for x in personal_data._best_paths(w, scores, [(s, s + len(t))]))
    assert sorted(found) == whole  # what isn't decoded is all outside


def test_windows_agree_with_one_pass():
    """A character's tags don't depend on where windows begin."""
    w = personal_data.trained(**TRAINING)
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" '
    for pad in range(0, 600, 37):
        (_, spans), = personal_data.all_spans(w, ["word " * (pad // 5) + "x" * (pad % 5) + " " + text])
        assert [k for _, k, _ in spans] == [4] and spans[0][2] - spans[0][0] == 40


def test_personal_data_queries(spark, odd):
    texts = ["mail ann.lee@mail.example.com now", 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "only words here, and 3 of them", None, ""]
    rows = {r.doc_id: r for r in personal_data.find(table(spark, texts), **TRAINING).collect()}
    assert rows[0].spans == "email:5:29" and rows[0].base_sha256 == hashlib.sha256(b"email:5:29").hexdigest() and rows[0].n_email == 1
    assert rows[1].spans.startswith("secret:") and rows[2].spans == rows[3].spans == rows[4].spans == ""
    clean = {r.doc_id: (r.text, r.n_chars) for r in personal_data.redact(table(spark, texts), length_column="n_chars", **TRAINING).collect()}
    assert clean[0] == ("mail <EMAIL> now", 16) and "04dbeb" not in clean[1][0] and clean[2][0] == texts[2] and clean[3] == (None, None)
    assert personal_data.find(odd, **TRAINING).count() == odd.count() and personal_data.find(odd.limit(0), **TRAINING).count() == 0


# -- pages, benchmarks --------------------------------------------------------------------------


@pytest.mark.parametrize("html, expected", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<script>var a='</p>'</script><style>p{}</style>", ""),
    ("<nav><a>Menu one, two.</a></nav><article><h1>Title</h1><p>A  sentence,\n with <b>bold</b> text.<p>Another one &lt;here&gt;.</article><footer>Foot, note.</footer>", "Title\nA sentence, with bold text.\nAnother one <here>."),
    ("<div class='sidebar'><p>Side, bar.</p></div><div id=c><p>First, long paragraph of text, with marks.</p><p>Second one.</p></div><div class=comments><p>I think, no.</p></div>", "First, long paragraph of text, with marks.\nSecond one."),
    ("<article><p>Text, one.</p><div class='ad'>Buy, now!</div><form><p>Name, please.</p></form><p>Text, two.<!-- no --></p></article>", "Text, one.\nText, two."),
    ("<ul><li>a, b.<li>c, d.</ul>", "a, b.\nc, d."), ("<p>a < b, and c", "a < b, and c"), ("<div" * 3000, ""),
])
def test_main_text(html, expected):
    assert main_text.main_text(html) == expected


def test_main_text_query(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>Hi, you.</p>"), (2, None, "<p>Hi, you.</p>"), (None, "u", "<p>" * 20_000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = main_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "deep", 4), (1, "", 0), (2, "Hi, you.", 8), (2, "Hi, you.", 8)]
    assert main_text.extract(pages.limit(0)).count() == 0


def brute_hits(docs, items, min_matches=10, min_share=0.5, min_identity=0.8):
    out = set()
    block = decontamination.block_of([(i, t.encode()) for i, t in items])
    for d, text in enumerate(docs):
        own = decontamination.tokens((text or "").encode())
        for k, item in enumerate(block.tokens):
            for at in range(-len(item) + 1, len(own)):
                a, b = max(at, 0), min(at + len(item), len(own))
                if a >= b:
                    continue
                m, n = decontamination.best_stretch(item[a - at : b - at] == own[a:b])
                if m >= min(min_matches, len(item)) and m >= min_share * len(item) and m >= min_identity * n:
                    out.add((d, block.items[k]))
    return out


def test_decontamination(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(random.choices(words, k=k))) for i, k in enumerate([30, 14, 45, 5, 0, 30])]
    docs = []
    for i, (_, text) in enumerate(items):
        for edits in (0, 1, 3, 30):
            own = text.split()
            for _ in range(edits if own and i != 3 else 0):
                own[random.randrange(len(own))] = "edit"
            docs.append(" ".join(random.choices(words, k=40) + [w.upper() + "," for w in own] + random.choices(words, k=20)))
    docs += [None, "", items[0][1], items[2][1][: len(items[2][1]) // 3]]
    benchmark = spark.createDataFrame([*items, (9, None)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    expected = brute_hits(docs, items)
    for tokens in (decontamination.BLOCK_TOKENS, 40):
        found = {(r.doc_id, r.item_id) for r in decontamination.hits(table(spark, docs), benchmark, block_tokens=tokens).collect()}
        assert found == expected and len(found) > 10
        kept = {r.doc_id for r in decontamination.clean(table(spark, docs), benchmark, block_tokens=tokens).collect()}
        assert kept == set(range(len(docs))) - {d for d, _ in expected}
    assert decontamination.hits(table(spark, docs), benchmark.limit(0)).count() == 0 and decontamination.hits(table(spark, docs).limit(0), benchmark).count() == 0


# -- the pipeline -------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(4)
    words = ["the", "of", "and", "to", "in"] + [f"{a}{b}" for a in ("thing", "stor", "land", "water", "ston", "wind") for b in ("ing", "ed", "er", "s", "ly")]
    clean = [" ".join(random.choices(words, k=80)) for _ in range(60)]
    item = " ".join(random.choices(words, k=30))
    docs = [*clean, clean[0], clean[1] + " more", " ".join(random.choices(words, k=60)) + " " + item, "short", None, " ".join(w + "%%%" for w in clean[3].split()), clean[5] + " mail ann.lee@mail.example.com"]
    table(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {r.doc_id: r.text for r in out.collect()}
    near = brute_components(docs, 80)
    assert set(texts) == {i for i in range(60) if near[i][1] == i}
    whole = {r.doc_id: bytes(r.decoded).decode() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == texts


def test_stages_judge_rows_not_ids(spark):
    """Clean rows without an id, or with the id of a row that goes, stay."""
    import corpus_pipeline

    random.seed(9)
    words = ["the", "of", "and", "to", "in"] + [f"{a}{b}" for a in ("thing", "stor", "land", "water") for b in ("ing", "ed", "er", "s", "ly")]
    a, b, c, d = (" ".join(random.choices(words, k=120)) for _ in range(4))
    rows = [(None, a), (None, ""), (1, b), (1, "short"), (0, c), (2, c.upper()), (2, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = {(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, docs.where("text != upper(text) or text = ''"), "").collect()}
    assert out == {(None, a), (1, b), (0, c), (2, d)}
    out = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()}
    assert out == set(rows) - {(2, c.upper())}


def test_ratios_are_smoothed_at_every_size():
    random.seed(10)
    root, named = main_text.Path(), {}
    for _ in range(1500):
        p, steps = root, ["a"] * random.choice([0, 0, 70]) + [random.choice("abcdefgh") for _ in range(random.randint(1, 6))]
        for tag in steps:
            p = p.step(tag)
        named[p] = steps
    totals = {}
    for p in named:
        n = random.randint(1, 9)
        totals[p] = (n, n * random.randint(1, 90), random.choice([0, 0, 3]))
    assert len(totals) > 400
    fused = main_text.fused_ratios(totals)
    for p in random.sample(list(named), 40):
        sums = [0.0, 0.0, 0.0]
        for q, (n, chars, marks) in totals.items():
            common = sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(named[p], named[q], strict=False)))
            w = np.exp(-((len(named[p]) + len(named[q]) - 2 * common) ** 2) / 2) * np.log2(1 + n)
            sums = [sums[0] + w, sums[1] + w * chars / n, sums[2] + w * marks / n]
        assert fused[p] == pytest.approx(np.log2(1 + np.sqrt(sums[1] * sums[2]) / sums[0]), rel=1e-6, abs=1e-6)


def test_large_and_deep_pages_keep_their_text():
    plain = "".join(f"<x{i}>words without any marks {i}</x{i}>" for i in range(450))
    page = f"<body><div>{plain}<section>{''.join(f'<y{i}>One, two; three.</y{i}>' for i in range(450))}</section></div></body>"
    assert "words without any marks 7" in main_text.main_text(page)
    deep = main_text.blocks_of("<div>" * 80 + "<p>a</p><ul><li>b</li></ul>" + "</div>" * 80)
    assert len({p for b in deep for p, _ in b.pieces}) == 2
    deeper = main_text.main_text("<div>" * 30_000 + "<p>One, two.</p>" + "</div>" * 29_999 + "<p>Three, four.</p></div>")
    assert deeper == "One, two.\nThree, four."


def test_text_beside_a_long_body_stays():
    body = [f"Paragraph {i}, which is long enough to be one; it goes on, and ends." for i in range(80)]
    lead = "The lead, which is a sentence too; it tells what follows, in short."
    for page in (f"<body><h1>Title</h1><p>{lead}</p><div>{''.join(f'<p>{x}</p>' for x in body)}</div></body>", f"<body><main><h1>Title</h1><p>{lead}</p><article>{''.join(f'<p>{x}</p>' for x in body)}</article></main></body>"):
        assert main_text.main_text(page) == "\n".join(["Title", lead, *body])


def made_page(family, rng):
    """A page of a family with its article's blocks."""
    word = lambda: "".join(rng.choices("aeiourstnlm", k=rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(".!?")
    paragraphs = [" ".join(sentence(rng.randint(5, 16)).replace(" ", ", ", 1) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(2, 9))]
    title = sentence(rng.randint(3, 9)).rstrip(".")
    links = "".join(f"<li><a href=/{i}>{word()}</a></li>" for i in range(rng.randint(4, 9)))
    remarks = "".join(f"<div class=comment><p>{sentence(9)} {sentence(7)}</p></div>" for _ in range(3))
    own = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs)
    page = {
        "named": f"<header><a>{word()}</a></header><nav><ul>{links}</ul></nav><main><article>{own}</article></main><aside><p>{sentence(12)}</p></aside><footer><p>{sentence(9)}</p></footer>",
        "classes": f"<div class='top-nav'><ul>{links}</ul></div><div id=page><div class=story>{own}</div><div class='sidebar'><p>{sentence(14)}</p></div></div><div class='cookie-notice'><p>{sentence(9)}</p></div>",
        "bare": f"<ul>{links}</ul><div><div>{own}</div></div><table><tr><td><a>{word()}</a><td><a>{word()}</a></table>",
        "remarks": f"<ul class=menu>{links}</ul><section>{own}</section><div id=comments>{remarks}</div><form><p>{sentence(8)}</p></form>",
    }[family]
    return f"<html><head><title>{title}</title></head><body>{page}</body></html>", [title, *paragraphs]


@pytest.mark.parametrize("family", ["named", "classes", "bare", "remarks"])
def test_main_text_of_known_articles(family):
    rng = random.Random(11)
    kept = given = true = 0
    for _ in range(120):
        html, article = made_page(family, rng)
        found, own = Counter(main_text.main_text(html).split("\n")), Counter(article)
        kept, given, true = kept + sum((found & own).values()), given + sum(found.values()), true + sum(own.values())
    assert kept / true > 0.98 and kept / given > 0.98


def test_content_paths_by_brute_force():
    rng = random.Random(12)
    for _ in range(30):
        html, _ = made_page(rng.choice(["named", "classes", "bare", "remarks"]), rng)
        blocks = main_text.blocks_of(html)
        totals = {}
        for b in blocks:
            for p, text in b.pieces:
                n, chars, marks = totals.get(p, (0, 0, 0.0))
                totals[p] = (n + 1, chars + len(text.replace(" ", "")), marks + 0.5 + len(main_text._PUNCTUATION.findall(text)))

        def steps(p, q):
            n = 0
            while p is not q:
                p, q, n = (p.parent, q, n + 1) if p.depth >= q.depth else (p, q.parent, n + 1)
            return n

        score, prior = {}, main_text.priors(totals)
        for p in totals:
            w = {q: np.exp(-(steps(p, q) ** 2) / 2) * np.log2(1 + totals[q][0]) for q in totals}
            chars, marks = (sum(w[q] * totals[q][k] / totals[q][0] for q in totals) / sum(w.values()) for k in (1, 2))
            score[p] = np.log2(1 + np.sqrt(chars * marks)) * prior[p]
        mean = sum(score[p] * totals[p][1] * prior[p] for p in totals) / sum(totals[p][1] * prior[p] for p in totals)
        content = {p for p in totals if score[p] >= main_text.THRESHOLD * mean}
        assert content == main_text.content_paths(totals)
        assert main_text.main_text(html).count("\n") + 1 == sum(any(p in content for p, _ in b.pieces) for b in blocks)


def test_words_of_boilerplate_in_compounds_are_no_verdict():
    body = "".join(f"<p>Sentence {i}, of the article; it is long enough.</p>" for i in range(6))
    page = f"<article>{body}<div class='share-prices'><p>Shares of the firm fell, by a tenth.</p></div>{body}<div class='share'><p>Share this, now.</p></div></article>"
    found = main_text.main_text(page)
    assert "Shares of the firm" in found and "Share this" not in found


def test_no_accepted_overlap_lacks_a_seed():
    """Every pattern of matches that verification accepts holds a window of a mask: a search through all patterns of up to 34 words without such a window."""
    kept = [(len(m), [i for i, c in enumerate(m) if c == "1"]) for m in decontamination.MASKS]
    limits = decontamination.DEFAULTS
    missed = []

    def seeded(p):
        return any(len(p) >= n and all(p[len(p) - n + i] for i in keep) for n, keep in kept)

    def go(p, score, best):
        if p and p[-1] and score > best and sum(p) >= limits["min_matches"] and sum(p) >= limits["min_identity"] * len(p):
            missed.append(tuple(p))
        if len(p) < 34:
            if not seeded([*p, 1]):
                go([*p, 1], score + 1, max(best, score))
            if score >= decontamination.SUBSTITUTION:
                go([*p, 0], score - decontamination.SUBSTITUTION, max(best, score))

    go([], 0, 0)
    assert not missed


def test_substitutions_at_the_ends_are_found():
    item = " ".join(f"w{i}" for i in range(12))
    block = decontamination.block_of([(1, item.encode())])
    for edited in ([0], [11], [0, 11], [3], [5], [3, 7], [0, 1]):
        doc = decontamination.tokens(" ".join("x" if i in edited else f"w{i}" for i in range(12)).encode())
        assert bool(decontamination.contained(block, [doc], **decontamination.DEFAULTS)[0]) == (decontamination.best_stretch(np.array([i not in edited for i in range(12)]))[0] >= 10), edited


def test_passages_shared_by_many_items(monkeypatch):
    monkeypatch.setattr(decontamination, "PAIRS", 50)
    shared = " ".join(f"s{i}" for i in range(15))
    items = [(i, f"{shared} a{i}".encode()) for i in range(40)]
    block = decontamination.block_of(items)
    docs = [decontamination.tokens(f"x {shared} y".encode()) for _ in range(10)]
    found = decontamination.contained(block, docs, **decontamination.DEFAULTS)
    assert all(len(f) == 40 for f in found)
    assert all(len(f) >= 1 for f in decontamination.contained(block, docs, **decontamination.DEFAULTS, all_items=False))


def test_badly_encoded_texts(spark):
    """Bytes that aren't UTF-8 crash nothing and lose no row."""
    bad = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe text " * 30)), (2, bytearray(b"\xc3")), (3, None)], "doc_id long, raw binary")
    docs = bad.select("doc_id", F.expr("cast(raw as string)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit("u").alias("url"))
    benchmark = docs.select(F.col("doc_id").alias("item_id"), "text")
    for out in (packing.pack(docs), bpe.encode_documents(docs), bpe.encode_digests(docs), token_counts.count_tokens(docs), personal_data.find(docs, **TRAINING), personal_data.redact(docs, length_column="n_chars", **TRAINING), near_duplicates.near_duplicates(docs), divergence.quality(docs), main_text.extract(pages), warc.round_trip(pages), sharding.shard(docs)):
        rows = out.collect()
        assert len(rows) == 3 or out.columns[0] == "row_id"
    assert decontamination.hits(docs, benchmark).count() >= 1
    assert {r.doc_id: r.n_tokens for r in bpe.encode_digests(docs).collect()}[3] == 0


def test_tagger_on_text_that_no_generator_made():
    w = personal_data.trained(**TRAINING)
    text = "Write to maria.keller@uni-example.edu before Friday, or call +44 (20) 794-6001; the server at 10.4.0.17 keeps api_key = \"9f86d081884c7d659a2feaa0c55ad015\" in plain text. Version 2.10.3 of 14 May costs 35.90, see page 112."
    (base, spans), = personal_data.all_spans(w, [text])
    values = [text[a:b] for a, _, b in spans]
    assert [text[a:b] for a, _, b in base] == ["maria.keller@uni-example.edu", "+44 (20) 794-6001", "10.4.0.17"] and "9f86d081884c7d659a2feaa0c55ad015" in values
    assert not any(x in v for v in values for x in ("2.10.3", "35.90", "112"))


def long_paragraph_in(name, where="class"):
    body = "".join(f"<p>Sentence {i}, of the article; it is long enough to be one.</p>" for i in range(6))
    own = "The paragraph that stands in an element of this name, which is as long as any other; it goes on, says more, and ends here."
    return own, f"<body><nav><a href=/>Home</a></nav><article>{body}<div {where}='{name}'><p>{own}</p></div>{body}</article><footer><p>Foot, note.</p></footer></body>"


@pytest.mark.parametrize("word", sorted(main_text.SURE_WORDS | main_text.PERHAPS_WORDS))
def test_compounds_of_listed_words_keep_their_text(word):
    for name in (f"recipe-{word}", f"{word}-on-budget", f"{word}y-theme", f"pre{word}", f"story_{word}", f"{word}Story"):
        own, page = long_paragraph_in(name)
        assert own in main_text.main_text(page), name


def test_names_that_may_tell_something_lower_a_score_only():
    for word in main_text.PERHAPS_WORDS:
        own, page = long_paragraph_in(word)
        assert own in main_text.main_text(page), word
        assert "Share it, now." not in main_text.main_text(page.replace(own, "Share it, now.")), word
    for word in ("ad", "sidebar", "top-nav", "cookie-notice", "site-footer", "comments", "comment-list"):
        own, page = long_paragraph_in(word)
        assert own not in main_text.main_text(page), word


def test_an_element_with_most_of_the_text_is_not_overruled_by_its_name():
    body = "".join(f"<p>Course {i}, with a sauce of the season; it serves two, or three.</p>" for i in range(20))
    found = main_text.main_text(f"<body><p>We open at six.</p><div class=menu>{body}</div></body>")
    assert found.count("Course") == 20


def test_badly_encoded_urls(spark):
    rows = spark.createDataFrame([(i, bytearray(b"http://x/\xff"), "same" if i % 2 else f"page {i}") for i in range(900)], "page_id long, raw binary, html string")
    found = {r.page_id: r for r in warc.round_trip(rows.select("page_id", F.expr("cast(raw as string)").alias("url"), "html")).collect()}
    assert len(found) == 900 and {r.url for r in found.values()} == {"http://x/\ufffd"}
    assert all(r.record_type == ("revisit" if i % 2 and i != 899 else "response") for i, r in found.items())


def test_badly_encoded_fields_are_read():
    data = warc.record(1, "http://x/\u00e9", b"a", warc.digest(b"a"), None)
    assert warc.parsed(data.replace("\u00e9".encode(), b"\xff\xfe"), "here")["warc-target-uri"] == "http://x/\ufffd\ufffd"


def test_added_tokens_in_long_pieces():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["ab1," * 1100 + "<|endoftext|>", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|> c", "x" * 5000 + "<|endoftext|>" + "y1" * 4000]
    texts += ["".join(rng.choice(["ab1,", "<|endoftext|>", "<|endof", "é", "1;", " ", "|>"]) for _ in range(n)) for n in (5, 50, 4000, 9000)]
    assert token_counts.counter(path).of(texts) == [len(model.encode(x, add_special_tokens=False).ids) for x in texts]
