"""Git as a data source, facts kept by content, and streams whose state ends."""

import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import git_source


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("git")
    run = lambda *w: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *w], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for n in range(30):
        (root / f"f{n}.py").write_text(f"x = {n}\n" * (n + 1))
    (root / "sub dir").mkdir()
    (root / "sub dir" / "é.ts").write_text("let ü = 1;\n")
    (root / "bad.txt").write_bytes(b"\xff\xfe")
    run("add", ".")
    run("commit", "-qm", "one")
    run("tag", "one")
    (root / "f0.py").write_text("y = 0\n")
    (root / "f1.py").unlink()
    (root / "new.py").write_text("z\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    return str(root)


def test_files_of_revisions(spark, repository):
    df = git_source.registered(spark).read.format("git_files").options(repository=repository, revisions="one,HEAD", most=100, objects=7).load()
    rows = {(r.revision, r.path): r for r in df.collect()}
    assert len(rows) == 64 and df.rdd.getNumPartitions() > 5
    assert rows["one", "f0.py"].text == "x = 0\n" and rows["HEAD", "f0.py"].text == "y = 0\n" and ("HEAD", "f1.py") not in rows
    assert rows["one", "f29.py"].omitted and rows["one", "f29.py"].text is None and rows["one", "sub dir/é.ts"].text == "let ü = 1;\n" and rows["HEAD", "bad.txt"].text == "��"


def test_options_choose_what_is_listed(spark, repository):
    options = {"repository": repository, "revisions": "HEAD", "prefix": "f1", "suffixes": ".py,.ts"}
    own = git_source.registered(spark).read.format("git_files").options(**options).load()
    assert {r.path for r in own.collect()} == {f"f{n}.py" for n in range(10, 20)}
    assert sum(len(p.rows) for p in git_source.FilesReader(options, None).partitions()) == 10


def test_changes_between_states(spark, repository):
    found = {r.path: (r.kind, r.before, r.after) for r in git_source.changes(spark, repository, "one", "HEAD").collect()}
    assert found == {"f0.py": ("modified", "x = 0\n", "y = 0\n"), "f1.py": ("deleted", "x = 1\n" * 2, None), "new.py": ("added", None, "z\n")}
    assert git_source.changes(spark, repository, ":parent", "one").where("kind = 'added'").count() == 32
    assert git_source.changes(spark, repository, "HEAD", git_source.WORKTREE).count() == 0


def test_version_pairs(spark, repository):
    pairs, states = git_source.version_pair(spark, repository, "one", "HEAD", most=100)
    rows = {r.path: r for r in pairs.collect()}
    assert len(rows) == 33 and not rows["f0.py"].same and rows["f2.py"].same and rows["new.py"].before is None and rows["f1.py"].after is None
    assert {r.revision: (r.files, r.availability) for r in states.collect()} == {"one": (32, "partial"), "HEAD": (32, "partial")}


def test_facts_are_kept_by_content(spark, tmp_path):
    from ledgerline.functions import syntax
    from ledgerline.sources import fact_cache
    from ledgerline.sources.tables import read_generation

    root = str(tmp_path / "facts")
    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    facts = lambda df: syntax.nodes(df.mapInArrow(counted, df.schema)).where("kind = 'call'").select("path", "name", "line")
    table = lambda rows: spark.createDataFrame(rows, "path string, language string, content string")
    first = [(f"a{i}.ts", "typescript", f"f{i % 5}(1);") for i in range(20)] + [("none.ts", "typescript", "x;"), ("null.ts", "typescript", None)]
    found, misses = fact_cache.cached(table(first), facts, root, "calls", "v1", F.lit("2024-01-01").cast("timestamp"))
    assert {(r.path, r.name) for r in found.collect()} == {(f"a{i}.ts", f"f{i % 5}") for i in range(20)} and misses.count() == 7 and parsed.value == 7
    again = [(p, k, "fresh(); f1(2);" if p == "a3.ts" else c) for p, k, c in first] + [("moved.ts", "typescript", "f4(1);"), ("a.py", "python", "f4(1);")]
    found, misses = fact_cache.cached(table(again), facts, root, "calls", "v1", F.lit("2024-01-10").cast("timestamp"))
    rows = {(r.path, r.name) for r in found.collect()}
    assert ("moved.ts", "f4") in rows and ("a3.ts", "fresh") in rows and ("a3.ts", "f3") not in rows and len(rows) == 23
    assert misses.count() == 2 and parsed.value == 9  # only what changed was parsed, and what another language makes of a text
    assert fact_cache.cached(table(first), facts, root, "calls", "v2", F.lit("2024-01-02").cast("timestamp"))[1].count() == 7  # another question
    log = read_generation(spark, root)
    assert log.count() == 16
    assert fact_cache.evict(root, log, F.lit("2024-02-05").cast("timestamp")).count() == 9  # those used on the 10th: f3's content too, under other paths
    assert fact_cache.evict(root, read_generation(spark, root), F.lit("2024-01-12").cast("timestamp"), entries=4).count() == 4
    total = read_generation(spark, root).agg(F.sum("bytes")).first()[0]
    assert fact_cache.evict(root, read_generation(spark, root), F.lit("2024-01-12").cast("timestamp"), total=total - 1).count() == 3


def _streamed(spark, tmp_path, name, schema, batches, make):
    """What a stream gives of files that come one after the other, and the numbers of keys with state after each."""
    folder = tmp_path / name
    folder.mkdir()
    query = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-progress")).start()
    kept = []
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"{name}-{i}"))
            for f in (tmp_path / f"{name}-{i}").glob("part-*"):
                f.rename(folder / f"{i}-{f.name}")
            query.processAllAvailable()
            kept.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    finally:
        query.stop()
    return spark.table(name).collect(), kept


def test_sessions_end_in_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    from ledgerline.streaming import expiry

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[("a", at(0)), ("b", at(1)), ("c", at(2)), ("a", at(5))], [("a", at(9)), ("d", at(30))], [("b", at(31)), ("e", at(32))], [("z", at(200))], [("z", at(203))]]
    found, kept = _streamed(spark, tmp_path, "sessions", "session string, at timestamp", batches, lambda s: expiry.session_stream(s, 10_000))
    every = spark.createDataFrame([r for b in batches for r in b], "session string, at timestamp")
    expected = {tuple(r) for r in expiry.session_log(every, 10_000, F.lit("2024-01-01 00:03:20").cast("timestamp")).collect()}
    assert {tuple(r) for r in found} == expected and ("a", "expired", at(19)) in expected and ("e", "expired", at(42)) in expected
    assert kept[-1] < kept[0]


def test_leases_end_in_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    from ledgerline.streaming import expiry, lifecycle

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "target string, request_id string, action string, owner string, token long, at timestamp, ttl long"
    ask = lambda i, t, action, owner, token, s: (t, f"r{i:02}", action, owner, token, at(s), 10_000)
    batches = [
        [ask(0, "x", "acquire", "p", 0, 0), ask(1, "x", "acquire", "q", 0, 3), ask(2, "y", "acquire", "q", 0, 4), ask(3, "y", "release", "q", 1, 5)], [ask(4, "x", "renew", "p", 1, 8), ask(5, "x", "acquire", "q", 0, 30)],
        [ask(6, "z", "acquire", "p", 0, 100)], [ask(7, "x", "acquire", "p", 0, 101), ask(8, "y", "acquire", "p", 0, 102)],
    ]
    found, _ = _streamed(spark, tmp_path, "leases", schema, batches, expiry.expiring_leases)
    answers = {r.request_id: (r.answer, r.token) for r in found if r.request_id}
    log = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("now", F.unix_millis("at"))
    assert answers == {r.request_id: (r.answer, r.token) for r in lifecycle.lease_answers(log, "request_id").collect()}
    assert {(r.target, r.token, r.at) for r in found if r.answer == "expired"} == {("x", 1, at(18)), ("x", 2, at(40))}
