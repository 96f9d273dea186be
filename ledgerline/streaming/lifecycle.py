"""Lifecycles, leases and sessions over append-only logs: folds in batch, and the same as streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.shipping import ship

#: What may follow what.
NEXT = {None: "verified", "verified": "claimed", "claimed": "completed_local", "completed_local": "completed"}
ZERO_HASH = "0" * 64


def task_status(events: DataFrame) -> DataFrame:
    """The type of each task's last event (task, sequence, type)."""
    return events.groupBy("task").agg(F.max_by("type", "sequence").alias("status"), F.max("sequence").alias("sequence"))


def allowed(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for a, b in NEXT.items():
        out = out | ((before.isNull() if a is None else before.eqNullSafe(F.lit(a))) & (after == b))
    return out


def event_hash(*columns: str) -> Column:
    """SHA-256 of an event's own fields; fields are told apart by their lengths."""
    parts = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts]), 256)


def validate_chain(events: DataFrame, constant: tuple[str, ...] = ()) -> DataFrame:
    """Each task with the first thing wrong with its log, or null: a gap in the sequence, a first event that isn't the first kind or refers back, a hash that isn't that of the event before, a step that isn't allowed, a field that should stay."""
    w = Window.partitionBy("task").orderBy("sequence")
    out = events.withColumns({"n": F.row_number().over(w), "before": F.lag("type").over(w), "hash_before": F.lag("event_hash").over(w), **{f"first_{c}": F.first(c).over(w) for c in constant}})
    changed = F.lit(False)
    for c in constant:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"first_{c}"))
    wrong = (
        F.when(F.col("sequence") != F.col("n"), "sequence").when((F.col("n") == 1) & (F.col("prev_event_hash") != ZERO_HASH), "first_hash")
        .when((F.col("n") > 1) & ~F.col("prev_event_hash").eqNullSafe(F.col("hash_before")), "hash").when(~allowed(F.col("before"), F.col("type")), "transition").when(changed, "changed")
    )
    return out.withColumn("wrong", wrong).groupBy("task").agg(F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("n"))).alias("wrong"))


def live(leases: DataFrame, now: Column, *order: str) -> DataFrame:
    """Leases that run on at now; one that expires at now doesn't."""
    return leases.where(F.col("expires_at") > now).orderBy(*order)


def sessions(beats: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """Runs of heartbeats whose gaps are under ttl: key, start, end, beats. Works on a stream with a watermark too."""
    return beats.groupBy(F.col(key), F.session_window(ts, ttl).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def _status_of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sequence, status, early = state.get if state.exists else (0, None, "{}")
    waiting: dict[int, str] = {int(k): v for k, v in json.loads(early).items()}
    for batch in batches:
        for row in batch.sort_values("sequence").itertuples():
            if row.sequence > sequence:
                waiting.setdefault(int(row.sequence), row.type)  # others are late or repeated
    while (following := waiting.get(sequence + 1)) is not None:
        if NEXT.get(status) != following:
            del waiting[sequence + 1]  # not allowed; another event may still take its place
            break
        sequence, status = sequence + 1, waiting.pop(sequence + 1)
    state.update((sequence, status, json.dumps(waiting)))
    yield pd.DataFrame({"task": [key[0]], "sequence": [sequence], "status": [status]})


def status_stream(events: DataFrame) -> DataFrame:
    """The running status of each task over a stream of events (task, sequence, type). An event that comes before its turn waits for it in the state."""
    ship(events.sparkSession)
    return events.groupBy("task").applyInPandasWithState(_status_of, "task string, sequence long, status string", "sequence long, status string, early string", "update", GroupStateTimeout.NoTimeout)


def lease_step(held: tuple[str, int, int] | None, token: int, request: dict[str, Any]) -> tuple[tuple[str, int, int] | None, int, str]:
    """One request on a target's lease (owner, fencing token, expiry in microseconds): the lease, the last token given, and the answer.

    A lease that has run out is gone first. acquire needs it free and gives the next token; renew and release
    need the holder's token; releasing what isn't held is no error.
    """
    now = request["now"]
    if held and now >= held[2]:
        held = None
    if request["action"] == "acquire":
        if held:
            return held, token, "held"
        return (request["owner"], token + 1, now + request["ttl"]), token + 1, "acquired"
    own = held is not None and held[0] == request["owner"] and held[1] == request["token"]
    if request["action"] == "renew":
        return ((held[0], held[1], now + request["ttl"]) if own else held), token, "renewed" if own else "lost"
    return (None if own else held), token, "released" if own or held is None else "lost"


LEASE_ANSWERS = "target string, request_id string, answer string, token long, expires_at long"


def _leases(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    owner, mine, expires, token = state.get if state.exists else (None, 0, 0, 0)
    held = (owner, mine, expires) if owner is not None else None
    out = []
    rows = sorted((r for b in batches for r in b.to_dict("records")), key=lambda r: (r["now"], r["request_id"]))
    for r in rows:
        held, token, answer = lease_step(held, token, r)
        out.append((key[0], r["request_id"], answer, held[1] if held else None, held[2] if held else None))
    state.update((held[0], held[1], held[2], token) if held else (None, 0, 0, token))
    yield pd.DataFrame(out, columns=["target", "request_id", "answer", "token", "expires_at"])


def lease_stream(requests: DataFrame) -> DataFrame:
    """Answers to a stream of requests (target, request_id, action, owner, token, now, ttl), each target's lease and last token kept as state; tokens only grow."""
    ship(requests.sparkSession)
    return requests.groupBy("target").applyInPandasWithState(_leases, LEASE_ANSWERS, "owner string, mine long, expires long, token long", "append", GroupStateTimeout.NoTimeout)


def lease_answers(requests: DataFrame, *order: str) -> DataFrame:
    """The answers to a log of requests, as lease_stream gives them: each target's requests by time and order.

    Targets come sorted, a batch at a time, with the lease as running state: memory doesn't grow with a target's log.
    """
    ship(requests.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, held, token = None, None, 0
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if r["target"] != target:
                    target, held, token = r["target"], None, 0
                held, token, answer = lease_step(held, token, r)
                out.append((target, r["request_id"], answer, held[1] if held else None, held[2] if held else None))
            yield pd.DataFrame(out, columns=["target", "request_id", "answer", "token", "expires_at"])

    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(n, "target").sortWithinPartitions("target", "now", *order).mapInPandas(run, LEASE_ANSWERS)


def bounded_fan_out(events: DataFrame, subscriber: str, seq: str, capacity: int = 64) -> DataFrame:
    """For each subscriber the events delivered from one burst, up to its capacity, and those dropped."""
    ranked = events.withColumn("_r", F.row_number().over(Window.partitionBy(subscriber).orderBy(seq)))
    return ranked.groupBy(subscriber).agg(F.count_if(F.col("_r") <= capacity).alias("delivered"), F.count_if(F.col("_r") > capacity).alias("dropped"))


def append_log(events: DataFrame, path: str, checkpoint: str) -> Any:
    """Append a stream of events to a log of JSON lines; ends when what is there is written."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refresh_projection(log: DataFrame, path: str) -> None:
    """Write anew the number of events and the last one by key."""
    log.groupBy("task").agg(F.count(F.lit(1)).alias("events"), F.max_by("type", "sequence").alias("status")).write.mode("overwrite").parquet(path)


def link_events(log: DataFrame, events: DataFrame) -> DataFrame:
    """New events (task, and their own columns) with the next sequence and the hash of the task's last event, or the first sequence and zeros. At most one new event for each task."""
    last = log.groupBy("task").agg(F.max("sequence").alias("_last"), F.max_by("event_hash", "sequence").alias("_hash"))
    return events.join(last, "task", "left").withColumns({"sequence": F.coalesce(F.col("_last") + 1, F.lit(1)).cast("long"), "prev_event_hash": F.coalesce("_hash", F.lit(ZERO_HASH))}).drop("_last", "_hash")


def submissions(proposals: DataFrame, log: DataFrame, scopes: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Each proposal (task, scope, proposal_hash) with its answer: unknown_scope, cycle, repeated (the log has it with this hash), conflict (with another) or verified."""
    known = log.groupBy("task").agg(F.min_by("proposal_hash", "sequence").alias("_hash"))
    own = proposals.join(scopes.select("scope").distinct().withColumn("_scope", F.lit(True)), "scope", "left").join(cyclic.select("task").distinct().withColumn("_cycle", F.lit(True)), "task", "left").join(known, "task", "left")
    answer = F.when(F.col("_scope").isNull(), "unknown_scope").when(F.col("_cycle"), "cycle").when(F.col("_hash") == F.col("proposal_hash"), "repeated").when(F.col("_hash").isNotNull(), "conflict").otherwise("verified")
    return own.select("task", "scope", "proposal_hash", answer.alias("answer"))


def transitions(requests: DataFrame, status: DataFrame, ready: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """Each request (task, to, owner) with its answer: not_allowed after the task's status, waiting for its dependencies (ready), not_held without a live lease (target, owner, expires_at), or the new status."""
    own = requests.join(status.select("task", "status"), "task", "left").join(ready, "task", "left")
    held = leases.where(F.col("expires_at") > now).select(F.col("target").alias("task"), "owner").distinct().withColumn("_held", F.lit(True))
    own = own.join(held, ["task", "owner"], "left")
    answer = F.when(~allowed(F.col("status"), F.col("to")), "not_allowed").when((F.col("to") == "claimed") & ~F.coalesce("ready", F.lit(True)), "waiting").when(F.coalesce("_held", F.lit(False)), F.col("to")).otherwise("not_held")
    return own.select("task", "to", "owner", answer.alias("answer"))


def ingest(evidence: DataFrame, valid: Column, log: str, projection: str) -> DataFrame:
    """Append valid evidence to a log of JSON lines and write its counts by rule anew; what isn't valid comes back."""
    rejected = evidence.where(~F.coalesce(valid, F.lit(False)))
    evidence.where(valid).write.mode("append").json(log)
    evidence.sparkSession.read.schema(evidence.schema).json(log).groupBy("rule_id").agg(F.count(F.lit(1)).alias("entries")).write.mode("overwrite").parquet(projection)
    return rejected
