"""Sources and sinks over files: project sources, markdown, JSON logs, git output, and YAML edges."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.paths import EXCLUDED_SEGMENTS, file_kind_with_rules, in_scope, language_of, participates
from ledgerline.shipping import ship

MAX_BLOB = 512 * 1024
EVIDENCE_SCHEMA = "repository string, provider string, provider_version string, rule_id string, findings long, verdict string, project string, observed_at timestamp"


def project_files(spark: SparkSession, root: str, extensions: Sequence[str], population: str = "observed", kinds: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(path, language, kind, size, hash, content) of source files below root in scope and population. Equal paths come once; listing and reading are Spark's."""
    base = "/" + re.sub(r"^[a-z0-9]+:/*", "", root.rstrip("/")).lstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(base) + "/", "")
    own = raw.select(path.alias("path"), "length", "content").where(in_scope(F.col("path"), extensions))
    kind = file_kind_with_rules(F.col("path"), kinds)
    own = own.withColumn("kind", kind).where(participates(F.col("kind"), population)).dropDuplicates(["path"])
    return own.select("path", language_of(F.col("path")).alias("language"), "kind", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def source_snapshot(files: DataFrame) -> DataFrame:
    """One row: the identity of all (path, hash) pairs in order; null if a hash is missing. The pairs are hashed by chunk of paths first."""
    chunk = F.substring(F.sha2("path", 256), 1, 3)
    parts = files.groupBy(chunk.alias("chunk")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "hash")))), 256).alias("part"), F.count_if(F.col("hash").isNull()).alias("missing"))
    return parts.agg(F.when(F.coalesce(F.sum("missing"), F.lit(0)) == 0, F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("chunk", "part")))), 256)).alias("snapshot_sha256"))


def markdown_files(spark: SparkSession, root: str, skip: Sequence[str] = (".git",)) -> DataFrame:
    """(path, content) of *.md below root."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return raw.where(~F.col("path").rlike("/(" + "|".join(map(re.escape, skip)) + ")/"))


def evidence_log(spark: SparkSession, path: str, schema: str = EVIDENCE_SCHEMA) -> DataFrame:
    """A log of JSON lines; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def replace_evidence(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parse_name_status(log: str) -> Iterator[tuple[str, str, str, int]]:
    """(commit, path, kind, position) of `git log --format=%x01%H --name-status` output; only added, modified and deleted files."""
    kinds = {"A": "added", "M": "modified", "D": "deleted"}
    for position, block in enumerate(log.split("\x01")[1:]):
        commit, _, rest = block.partition("\n")
        for line in rest.splitlines():
            status, tab, path = line.partition("\t")
            if tab and status in kinds:
                yield commit.strip(), path, kinds[status], position


def commit_history(spark: SparkSession, repository: str, most: int = 100) -> DataFrame:
    """The last commits' changes, by git itself. The number of commits is the feature's."""
    log = subprocess.run(["git", "-C", repository, "log", f"-{most}", "--no-renames", "--format=%x01%H", "--name-status"], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame(list(parse_name_status(log)), "id string, path string, kind string, position int")


def parse_hunks(diff: str) -> list[tuple[str, int, int, int, int]]:
    """(file, before start, before lines, after start, after lines) of a unified diff."""
    out, name = [], ""
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = re.sub(r"^b/", "", line[4:].split("\t")[0])
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            a, b, c, d = m.groups()
            out.append((name, int(a), int(b) if b is not None else 1, int(c), int(d) if d is not None else 1))
    return out


def hunks(diffs: DataFrame, column: str = "diff") -> DataFrame:
    """A row for each hunk of a column of diffs."""
    ship(diffs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([h for d in batch[column].dropna() for h in parse_hunks(d)], columns=["file", "before_start", "before_lines", "after_start", "after_lines"])

    return diffs.select(column).mapInPandas(run, "file string, before_start int, before_lines int, after_start int, after_lines int")


def blobs(requests: DataFrame, store: DataFrame, most: int = MAX_BLOB) -> DataFrame:
    """Requested paths with their text; text over the limit is left out (omitted), and what isn't stored is missing."""
    joined = requests.join(store.select("path", "text", F.lit(True).alias("_there")), "path", "left")
    size = F.octet_length("text")
    status = F.when(F.col("_there").isNull(), "missing").when(size > most, "omitted").otherwise("available")
    return joined.select(*requests.columns, status.alias("status"), F.when(size <= most, F.col("text")).alias("text"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges with normal paths, without those that leave the root, each once."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/{2,}", "/"), r"^(\./)+", "")
    out = edges.withColumns({"src": norm("src"), "dst": norm("dst")})
    inside = lambda c: ~F.col(c).rlike(r"^/|(^|/)\.\.(/|$)|^[A-Za-z]:")
    return out.where(inside("src") & inside("dst")).dropDuplicates()


def implicit_edges(spark: SparkSession, text: str) -> DataFrame:
    """Edges of a YAML document (edges: - {from, to, via, type, source, confidence}); raises ValueError for malformed or repeated ones."""
    import yaml

    found = (yaml.safe_load(text) or {}).get("edges") or []
    rows = []
    for x in found:
        if not isinstance(x, dict) or not all(isinstance(x.get(k), str) and x[k] for k in ("from", "to", "via", "type")) or x.get("confidence", "low") not in ("low", "confirmed"):
            raise ValueError(f"malformed edge {x!r}")
        row = tuple(x.get(k) for k in ("from", "to", "via", "type", "source")) + (x.get("confidence", "low"),)
        if any(p.startswith("/") or ".." in p.split("/") for p in row[:2]):
            raise ValueError(f"edge {x!r} leaves the root")
        rows.append(row)
    if len(set(rows)) != len(rows):
        raise ValueError("repeated edges")
    return spark.createDataFrame(rows, "src string, dst string, via string, type string, source string, confidence string")


def excluded(path: str) -> bool:
    return any(part in EXCLUDED_SEGMENTS for part in path.split("/"))
