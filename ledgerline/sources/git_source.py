"""Git as data sources: the files of revisions, and what changed between two states. Executors read the texts.

The driver lists names, object ids and sizes alone; partitions are runs of objects of bounded number and bytes, and each task asks git for its own in one stream. The
repository is a folder that all executors see. The options `prefix` and `suffixes` (by commas) choose what is listed, so nothing else is read. They are options and no filters that
Spark pushes down: two scans of one DataFrame share a reader, so the filters of one would hold for the other.

    spark.dataSource.register(GitFiles)
    spark.read.format("git_files").option("repository", folder).option("revisions", "v1,HEAD").load()
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.shipping import ship
from ledgerline.sources.files import MAX_BLOB

FILES = "revision string, path string, object string, size long, text string, omitted boolean"
CHANGES = "path string, kind string, before string, after string, omitted boolean"
#: Objects and bytes of a partition, about; rows of a batch.
PART_OBJECTS, PART_BYTES, BATCH = 4096, 32 << 20, 256
INDEX, WORKTREE = ":index", ":worktree"
_KINDS = {"A": "added", "D": "deleted"}
_NONE = "0" * 40


def git(repository: str, *words: str) -> bytes:
    return subprocess.run(["git", "-C", repository, *words], capture_output=True, check=True).stdout


def plain(path: bytes) -> str:
    return path.decode("utf-8", "replace")


class Objects:
    """Texts of objects by their ids, in one stream of `git cat-file`."""

    def __init__(self, repository: str, most: int) -> None:
        self.most = most
        self.process = subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def text(self, name: str) -> tuple[str | None, bool]:
        """(text, omitted): no text where there is none, or beyond the limit."""
        self.process.stdin.write(name.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline()
        if head.endswith(b" missing\n") or not head:
            return None, False
        size = int(head.rsplit(b" ", 1)[1])
        left, parts = size + 1, []
        while left:
            data = self.process.stdout.read(min(left, 1 << 20))
            if not data:
                raise OSError(f"git ended within {name}")
            left -= len(data)
            if size <= self.most:
                parts.append(data)
        return (None, True) if size > self.most else (b"".join(parts)[:-1].decode("utf-8", "replace"), False)

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()


@dataclass
class Part(InputPartition):
    rows: list[tuple]


def parts_of(rows: Iterable[tuple], size: int | None, most: int = PART_OBJECTS) -> list[Part]:
    """Rows in runs; size: where in a row its bytes are, if they are known."""
    out, own, total = [], [], 0
    for r in rows:
        n = r[size] if size is not None else 0
        if own and (len(own) >= most or total + n > PART_BYTES):
            out.append(Part(own))
            own, total = [], 0
        own.append(r)
        total += n
    return [*out, Part(own)] if own or not out else out


class _Reader(DataSourceReader):
    """What both sources share: which paths are listed, and batches."""

    def __init__(self, options: dict[str, str], schema: pa.Schema) -> None:
        self.repository, self.most = options["repository"], int(options.get("most", MAX_BLOB))
        self.objects = int(options.get("objects", PART_OBJECTS))
        self.options, self.schema = dict(options), schema

    def chosen(self, path: str) -> bool:
        return path.startswith(self.options.get("prefix", "")) and path.endswith(tuple(x for x in self.options.get("suffixes", "").split(",") if x) or "")

    def batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        for r in rows:
            own.append(r)
            if len(own) >= BATCH:
                yield self.batch(own)
                own = []
        if own:
            yield self.batch(own)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


class FilesReader(_Reader):
    def partitions(self) -> list[Part]:
        def listed() -> Iterator[tuple]:
            for revision in dict.fromkeys(self.options.get("revisions", "HEAD").split(",")):
                for line in git(self.repository, "ls-tree", "-r", "-l", "-z", "--full-tree", revision).split(b"\0"):
                    head, _, path = line.partition(b"\t")
                    words = head.split()
                    if len(words) == 4 and words[1] == b"blob" and self.chosen(plain(path)):
                        yield revision, plain(path), words[2].decode(), int(words[3])

        return parts_of(listed(), 3, self.objects)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        objects = Objects(self.repository, self.most)
        try:
            yield from self.batches((*r, *objects.text(r[2])) for r in partition.rows)
        finally:
            objects.close()


class ChangesReader(_Reader):
    def partitions(self) -> list[Part]:
        before, after = self.options.get("before", "HEAD"), self.options.get("after", WORKTREE)
        if before == ":parent":  # of `after`; a first commit has the empty tree
            found = git(self.repository, "rev-list", "--parents", "-n", "1", after).decode().split()
            before = found[1] if len(found) > 1 else git(self.repository, "hash-object", "-t", "tree", "/dev/null").decode().strip()
        ends = ("--cached", before) if after == INDEX else (before,) if after == WORKTREE else (before, after)

        def listed() -> Iterator[tuple]:
            parts = git(self.repository, "diff", "--raw", "--no-abbrev", "--no-renames", "--ignore-submodules", "-z", *ends).split(b"\0")
            for head, path in zip(parts[::2], parts[1::2], strict=False):
                _, _, old, new, status = head.decode().split(" ")
                yield plain(path), _KINDS.get(status[:1], "modified"), old, new
            if after == WORKTREE:
                for path in git(self.repository, "ls-files", "--others", "--exclude-standard", "-z").split(b"\0"):
                    if path:
                        yield plain(path), "added", _NONE, _NONE

        return parts_of((r for r in listed() if self.chosen(r[0])), None, self.objects)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        objects = Objects(self.repository, self.most)
        files = self.options.get("after", WORKTREE) == WORKTREE

        def now(path: str, kind: str, name: str) -> tuple[str | None, bool]:
            if kind == "deleted" or not files:
                return objects.text(name) if kind != "deleted" else (None, False)
            with open(os.path.join(self.repository, path), "rb") as f:
                data = f.read(self.most + 1)
            return (None, True) if len(data) > self.most else (data.decode("utf-8", "replace"), False)

        def rows() -> Iterator[tuple]:
            for path, kind, old, new in partition.rows:
                one, big = objects.text(old) if kind != "added" else (None, False)
                two, bigger = now(path, kind, new)
                yield path, kind, one, two, big or bigger

        try:
            yield from self.batches(rows())
        finally:
            objects.close()


_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(x.split(" ")[0], _TYPES[x.split(" ")[1]]) for x in schema.split(", ")])


class GitFiles(DataSource):
    """revision, path, object, size, text, omitted of the files in `revisions` (by commas). Text over `most` bytes is omitted; `objects` is the number of them in a partition."""

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: object) -> FilesReader:
        return FilesReader(self.options, _arrow(FILES))


class GitChanges(DataSource):
    """path, kind, before, after, omitted of what changed from `before` (a revision, or :parent) to `after` (a revision, :index or :worktree with its new files)."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema: object) -> ChangesReader:
        return ChangesReader(self.options, _arrow(CHANGES))


def registered(spark: SparkSession) -> SparkSession:
    """The session with both sources."""
    ship(spark)
    for source in (GitFiles, GitChanges):
        spark.dataSource.register(source)
    return spark


def files(spark: SparkSession, repository: str, revisions: Sequence[str] = ("HEAD",), most: int = MAX_BLOB) -> DataFrame:
    return registered(spark).read.format("git_files").option("repository", repository).option("revisions", ",".join(revisions)).option("most", most).load()


def changes(spark: SparkSession, repository: str, before: str, after: str, most: int = MAX_BLOB) -> DataFrame:
    return registered(spark).read.format("git_changes").option("repository", repository).option("before", before).option("after", after).option("most", most).load()


def version_pair(spark: SparkSession, repository: str, before: str, after: str, most: int = MAX_BLOB) -> tuple[DataFrame, DataFrame]:
    """(pairs, states): each path of either revision with both texts (path, before, after, and whether its objects are the same), and each revision's state (revision, files, bytes, omitted, availability)."""
    own = {r: files(spark, repository, [r], most) for r in (before, after)}
    side = lambda r, name: own[r].select("path", F.col("text").alias(name), F.col("object").alias(f"_{name}"))
    pairs = side(before, "before").join(side(after, "after"), "path", "full_outer").select("path", "before", "after", F.col("_before").eqNullSafe(F.col("_after")).alias("same"))
    both = files(spark, repository, list(own), most)
    states = both.groupBy("revision").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if("omitted").alias("omitted"))
    return pairs, states.withColumn("availability", F.when(F.col("omitted") > 0, "partial").otherwise("available"))
