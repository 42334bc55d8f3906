"""Several sessions working on one queue, each key processed once.

Keys are dealt into hash ranges.  A session claims free ranges by a commit in the
shared folder and reads the log again: of several live claims the earliest stands.
A claim is a lease; when it runs out without a result, others may take the range.
A session writes its results to a folder of its own and then commits them as done.
For every range the first result committed counts, so even two sessions that both
believe in their claim (clocks differ) give each key once, and what a session
left behind when it died is never read.

The driver sees a row per range and claim, never keys or results.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.sources.events import commit, events

LOG = "range int, session string, event string, at double, expires double, folder string"
RANGE = "__range"


def range_of(key: str, ranges: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(ranges)).cast("int")


def _state(spark: SparkSession, folder: str) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """First live claim (at, session) and first result (at, folder) of every range."""
    claims: dict[int, tuple] = {}
    done: dict[int, tuple] = {}
    now = time.time()
    for r in events(spark, folder, LOG).collect():
        if r["event"] == "done":
            done[r["range"]] = min(done.get(r["range"], (r["at"], r["folder"])), (r["at"], r["folder"]))
        elif r["expires"] > now:
            claims[r["range"]] = min(claims.get(r["range"], (r["at"], r["session"])), (r["at"], r["session"]))
    return claims, done


def claim(spark: SparkSession, folder: str, session: str, ranges: int, take: int, lease: float) -> list[int]:
    """Up to ``take`` ranges that are now this session's."""
    claims, done = _state(spark, folder)
    free = [r for r in range(ranges) if r not in claims and r not in done]
    # sessions begin at different places, so they seldom want the same ranges
    begin = zlib.crc32(session.encode()) % max(1, len(free))
    wanted = (free[begin:] + free[:begin])[:take]
    if not wanted:
        return []
    now = time.time()
    commit(spark, folder, [(r, session, "claim", now, now + lease, "") for r in wanted], LOG)
    claims, done = _state(spark, folder)
    return [r for r in wanted if claims.get(r, (0, ""))[1] == session and r not in done]


def process_claims(queue: DataFrame, folder: str, key: str, step: Callable[[DataFrame], DataFrame],
                   ranges: int = 64, take: int = 8, lease: float = 3600.0, session: str | None = None,
                   rounds: int | None = None) -> int:
    """Claims ranges and processes their rows until none is free (or ``rounds`` times).

    ``step`` maps queue rows to results that keep the key column.  All sessions of
    a folder must use the same ``ranges``.  Returns the number of ranges done.
    """
    spark = queue.sparkSession
    session = session or uuid4().hex
    count = 0
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        mine = claim(spark, folder, session, ranges, take, lease)
        if not mine:
            break
        out = f"{folder}/results/{session}-{uuid4().hex}"
        rows = queue.where(range_of(key, ranges).isin(mine))
        step(rows).withColumn(RANGE, range_of(key, ranges)).write.parquet(out)
        now = time.time()
        commit(spark, folder, [(r, session, "done", now, now, out) for r in mine], LOG)
        count += len(mine)
    return count


def finished(spark: SparkSession, folder: str, ranges: int) -> bool:
    return len(_state(spark, folder)[1]) == ranges


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The results of all ranges that are done, each from the folder that counts."""
    _, done = _state(spark, folder)
    if not done:
        raise ValueError(f"nothing is done in {folder}")
    chosen: dict[str, list[int]] = {}
    for r, (_, out) in done.items():
        chosen.setdefault(out, []).append(r)
    parts = [spark.read.parquet(out).where(F.col(RANGE).isin(rs)).drop(RANGE) for out, rs in sorted(chosen.items())]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
