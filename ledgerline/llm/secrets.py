"""Secrets, judged by who has them: corpus-wide ownership of candidate values.

Each text is searched once for candidates: the base patterns (assignments, access keys, hexadecimal runs), and values that have no base
pattern: mixed keys (20 or more letters, digits, `_` and `-` with upper case, lower case, a digit and KEY_CHARACTERS different characters), passwords in addresses, and
private key blocks. Only a 128-bit hash of a candidate's value leaves the text. For each hash the corpus gives the number of distinct repositories and of distinct
owners that hold it, from pairs made distinct before they meet, so a value that fills the corpus costs a row for each of its owners. A value of more owners or repositories
than MAX_OWNERS and MAX_REPOSITORIES is a widely copied example; one of few that looks real (LIVE_CHARACTERS different characters, no word that marks a placeholder) is
live. Base spans stay, whatever their verdict; spans of the other kinds are added where their value is live and they overlap no base span.

Null texts are empty and have no spans. Bytes that aren't UTF-8 count as U+FFFD. A null repository or owner is one of its own. Repeated rows, and rows with null or repeated ids, each
give their row. An empty table gives no rows. Spans are sorted by start and then kind, ties (equal spans of one kind) can't be. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_row, join_one, materialise, ship, texts_of

#: The first three are the base kinds.
KINDS = ("assign", "access", "hex", "key", "url", "pem")
BASE = 3
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
KEY_CHARACTERS, LIVE_CHARACTERS = 10, 6
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "yourkey", "your_", "xxxx", "test", "123456789")

#: The base patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18

_NAMES = ("passw", "secret", "token", "key")
_RUN = re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{16,}")
_MIXED = re.compile(r"(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])")
_ADDRESS = re.compile(r"://([^\x20\x09-\x0D/:@]+):([^\x20\x09-\x0D/@]+)@")
_BLOCK = re.compile(r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----([^-]+)-----END [A-Z\x20]*PRIVATE KEY-----")

Found = tuple[int, int, int, str]  # start, kind, end, value


def base_spans(text: str) -> list[Found]:
    """The base kinds' findings, by start and then kind."""
    out: list[Found] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end(), m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    for run in _RUN.finditer(text):  # a hexadecimal run of this length lies in such a run
        out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(out)


def added_spans(text: str, base: list[Found]) -> list[Found]:
    """What the other patterns find beside the base spans, whoever has it."""
    out: list[Found] = []
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 20 and _MIXED.match(m.group()) and len(set(m.group())) >= KEY_CHARACTERS:
            out.append((m.start(), 3, m.end(), m.group()))
    if "://" in text:
        out += [(m.start(2), 4, m.end(2), m.group(2)) for m in _ADDRESS.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 5, m.end(), m.group(1)) for m in _BLOCK.finditer(text)]
    kept, at, taken = [], 0, 0
    for found in sorted(out):
        while at < len(base) and base[at][0] < found[2]:
            taken = max(taken, base[at][2])
            at += 1
        if taken <= found[0]:
            kept.append(found)
    return kept


def looks_real(value: str) -> bool:
    low = value.lower()
    return len(set(value)) >= LIVE_CHARACTERS and not any(x in low for x in PLACEHOLDERS)


def value_hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=16).digest()


_CANDIDATE = "struct<start:int,kind:int,end:int,hash:binary,real:boolean>"
_ARROW = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("real", pa.bool_())])


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """doc_id, repository, owner, the numbers of base spans, base_sha256, and all candidates with their values' hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS[:BASE]), ("base_sha256", pa.string()), ("candidates", pa.list_(_ARROW))])

    def run(columns: dict[str, pa.Array]) -> dict[str, object]:
        out: dict[str, list] = {n: [] for n in schema.names[3:]}
        for text in texts_of(columns["text"]):
            base = base_spans(text or "")
            for i, k in enumerate(KINDS[:BASE]):
                out[f"n_{k}"].append(sum(x[1] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in base).encode()).hexdigest())
            every = base + (added_spans(text, base) if text else [])
            out["candidates"].append([{"start": start, "kind": kind, "end": end, "hash": value_hash(value), "real": looks_real(value)} for start, kind, end, value in every])
        return out | {n: columns[n] for n in ("doc_id", "repository", "owner")}

    repository = F.col("source") if repository is None else repository
    owner = F.substring_index(F.col("source"), "/", 1) if owner is None else owner
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), F.col(text_column).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS[:BASE])
    return own.mapInArrow(by_row(run, schema), f"doc_id long, repository string, owner string, {counts}, base_sha256 string, candidates array<{_CANDIDATE}>")


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """hash, n (occurrences), n_repositories, n_owners and copied, of a table with hash, repository and owner."""

    def distinct(name: str) -> DataFrame:
        return found.select("hash", name).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias(f"n_{name}"))

    n = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    both = n.join(distinct("repository"), "hash").join(distinct("owner"), "hash")
    copied = (F.col("n_owner") > max_owners) | (F.col("n_repository") > max_repositories)
    return both.select("hash", "n", F.col("n_repository").alias("n_repositories"), F.col("n_owner").alias("n_owners"), copied.alias("copied"))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repository: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, the number of base spans of each kind, their SHA-256, all spans (base ones and live ones of other kinds), n_live and n_copied: candidates by verdict.

    The repository is `source`, the owner its part before the first slash, unless they are given.
    """
    ship(docs.sparkSession)
    scanned = materialise(scan(docs, id_column, text_column, repository, owner).withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = scanned.select("row", "repository", "owner", F.explode("candidates").alias("c")).select("row", "repository", "owner", "c.*")
    found = materialise(found, "candidates")
    owned = materialise(ownership(found, max_owners, max_repositories), "ownership")
    judged = join_one(found.drop("repository", "owner"), owned.select("hash", "copied"), "hash", counts=owned)
    live = F.col("real") & ~F.col("copied")
    shown = F.when((F.col("kind") < BASE) | live, F.struct("start", "kind", "end"))
    by_row_ = judged.groupBy("row").agg(F.array_sort(F.collect_list(shown)).alias("own"), F.count_if(live).alias("n_live"), F.count_if("copied").alias("n_copied"))
    names = F.array(*map(F.lit, KINDS))
    spelled = F.array_join(F.transform("own", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = scanned.drop("repository", "owner", "candidates").join(by_row_, "row", "left")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", F.coalesce(spelled, F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
