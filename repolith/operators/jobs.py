"""Jobs and cache as tables: states, admission, expiry, upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.operators.graph import saved

#: Days that a cache entry holds, minutes after a failure without a new try, hours that ended jobs stay, queue length.
TTL_DAYS, COOLDOWN_MINUTES, KEEP_HOURS, QUEUE = 365, 3, 24_000, 100


def latest_states(events: DataFrame) -> DataFrame:
    """One row per job_id from events (job_id, ts, ord, status): last status, and the first time of each state."""
    when = lambda s: F.min(F.when(F.col("status").isin(*s), F.col("ts")))
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "ord")).alias("status"), when(["queued"]).alias("created_at"), when(["processing"]).alias("started_at"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("ts"))).alias("completed_at"),
    )


def decisions(job_id, events: list[tuple], job: tuple | None, minutes: int) -> tuple[list[tuple], tuple | None]:
    """Decisions (job_id, ts, ord, decision) on the queued ones of one job's ``events`` (ts, ord, status, whether the cache has it), in
    order, and the job (status, created_at) after them. Refused requests leave the job as it is; one that is served is complete."""
    out = []
    for ts, ord_, status, cached in events:
        if status != "queued":
            job = (status, job[1] if job else ts)
            continue
        if job and job[0] in ("queued", "processing"):
            decision = "running"
        elif job and job[0] == "failed" and ts < job[1] + pd.Timedelta(minutes=minutes):
            decision = "cooling"
        elif cached:
            decision, job = "cached", ("completed", ts)
        else:
            decision, job = "admitted", ("queued", ts)
        out.append((job_id, ts, ord_, decision))
    return out, job


def with_cache(requests: DataFrame, cache: DataFrame, days: int = TTL_DAYS) -> DataFrame:
    """``requests`` (job_id, ts, ...) with ``cached``: whether an entry of ``cache`` (job_id, created_at) was there and valid at the time. Of
    several entries of a job the latest counts, as a later one replaces it."""
    latest = cache.groupBy("job_id").agg(F.max("created_at").alias("stored_at"))
    valid = (F.col("ts") >= F.col("stored_at")) & (F.col("ts") < F.col("stored_at") + F.make_dt_interval(days=F.lit(days)))
    return requests.join(latest, "job_id", "left").withColumn("cached", F.coalesce(valid, F.lit(False))).drop("stored_at")


def admitted(requests: DataFrame, minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """A decision for each queued row of ``requests`` (job_id, ts, ord, status, perhaps cached), in order of (ts, ord): ``running`` while
    the job is queued or processing, ``cooling`` if it has failed and was created less than the minutes before, ``cached`` if the
    cache serves it, else ``admitted``, which makes it a new job. A task holds the events of one job at a time."""
    if "cached" not in requests.columns:
        requests = requests.withColumn("cached", F.lit(False))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "ord"])
        found, _ = decisions(rows["job_id"].iloc[0], list(zip(rows["ts"], rows["ord"], rows["status"], rows["cached"])), None, minutes)
        return pd.DataFrame(found, columns=["job_id", "ts", "ord", "decision"])

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    return requests.select("job_id", "ts", "ord", "status", "cached").groupBy("job_id").applyInPandas(decide, f"job_id {kinds['job_id']}, ts {kinds['ts']}, ord {kinds['ord']}, decision string")


def queued_runs(requests: DataFrame, capacity: int = QUEUE, ranges: int | None = None) -> DataFrame:
    """``requests`` (queue, ts, ord, seconds) through first-in-first-out queues of ``capacity`` places with one consumer each:
    ``entered`` (a full queue makes a request wait for a place), ``started`` and ``finished``, in seconds since the epoch.

    A run ends at the latest of (arrival of an earlier request + all work from it on). A stretch of a queue is a pair: its
    work, and the latest of its arrivals less the work before each; of two stretches that follow each other the works add up, and
    the second's latest loses the first's work. So requests are sorted in ranges, each range sums itself up, and a row for each
    queue and range says what the ones before add: a single queue is many tasks' work. ``ranges``: how many, else as Spark deals.
    """
    by = ["queue", "ts", "ord"]
    dealt = requests.repartitionByRange(ranges, *by) if ranges else requests.repartitionByRange(*by)
    rows = saved(dealt.withColumns({"range": F.spark_partition_id(), "arrived": F.unix_micros("ts") / 1_000_000}))
    until = Window.partitionBy("queue", "range").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"work": F.sum("seconds").over(until), "place": F.count("*").over(until)}).withColumn("latest", F.max(F.col("arrived") - F.col("work") + F.col("seconds")).over(until))
    before = Window.partitionBy("queue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("queue", "range").agg(F.sum("seconds").alias("own"), F.count("*").alias("n"), F.max("latest").alias("peak"))
    sums = sums.withColumns({"work_before": F.coalesce(F.sum("own").over(before), F.lit(0)), "places_before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    sums = sums.withColumn("latest_before", F.max(F.col("peak") - F.col("work_before")).over(before)).select("queue", "range", "work_before", "places_before", "latest_before")
    rows = rows.join(sums, ["queue", "range"])
    finished = F.greatest(F.col("latest") - F.col("work_before"), "latest_before") + F.col("work_before") + F.col("work")
    rows = rows.withColumns({"finished": finished, "place": F.col("place") + F.col("places_before")}).withColumn("started", F.col("finished") - F.col("seconds"))
    # A place is free once the request that was ``capacity`` before has started.
    freed = rows.select("queue", (F.col("place") + capacity).alias("place"), F.col("started").alias("freed"))
    rows = rows.join(freed, ["queue", "place"], "left").withColumn("entered", F.greatest("arrived", "freed"))
    return rows.select(*requests.columns, "finished", "started", "entered")


def valid_entries(cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Entries younger than the limit; one exactly as old has expired."""
    return cache.filter(now < F.col("created_at") + F.make_dt_interval(days=F.lit(days)))


def after_cleanup(cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """What bulk cleanup keeps; one exactly at the limit stays."""
    return cache.filter(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))


def cached_documents(jobs: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``jobs`` (url_hash, ...) with the path of a cache entry that is still valid."""
    return jobs.join(valid_entries(cache, now).select("url_hash", "docs_path"), "url_hash", "left")


def retained(jobs: DataFrame, now: Column, hours: int = KEEP_HOURS) -> DataFrame:
    """``jobs`` without those that have ended and are older."""
    old = (F.col("created_at") < now - F.make_dt_interval(hours=F.lit(hours))) & F.col("status").isin("completed", "failed")
    return jobs.filter(~F.coalesce(old, F.lit(False)))


def recent(jobs: DataFrame, n: int | None = 100) -> DataFrame:
    out = jobs.orderBy(F.desc("created_at"), "job_id")
    return out.limit(n) if n else out


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with their keys."""
    return table.join(changes.select(key), key, "left_anti").select(table.columns).unionByName(changes.select(table.columns))


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def rebuilt_from_cache(jobs: DataFrame, cache_jobs: DataFrame) -> DataFrame:
    """``jobs`` and those of the cache whose ids are not among them."""
    return jobs.unionByName(cache_jobs.join(jobs.select("job_id"), "job_id", "left_anti").select(jobs.columns))


def progress(stages: DataFrame) -> DataFrame:
    """``stages`` (job_id, ord, weight, done) with overall progress: earlier weights and this one's part."""
    before = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return stages.withColumn("overall", F.coalesce(F.sum("weight").over(before), F.lit(0.0)) + F.col("weight") * F.col("done"))


def new_lint_errors(new: DataFrame, old: DataFrame, from_line: int, to_line: int, shift: int) -> DataFrame:
    """``new`` errors (line, col, problem) that aren't old ones moved by an edit of lines from_line to to_line."""
    kept = old.filter((F.col("line") < from_line) | (F.col("line") > to_line))
    moved = kept.withColumn("line", F.when(F.col("line") > to_line, F.col("line") + shift).otherwise(F.col("line")))
    return new.join(moved.select("line", "col", "problem"), ["line", "col", "problem"], "left_anti")


def edit_history(edits: DataFrame) -> DataFrame:
    """The latest content of each path, and the one before it for an undo."""
    by = Window.partitionBy("path").orderBy("version")
    rows = edits.withColumn("previous", F.lag("content").over(by))
    return rows.groupBy("path").agg(F.max_by("content", "version").alias("content"), F.max_by("previous", "version").alias("previous"), F.max("version").alias("version"))


def undone(steps: DataFrame) -> DataFrame:
    """``steps`` (path, version, kind, content; kind ``edit`` or ``undo``) with the ``depth`` of the path's stack of edits and the content ``shown``
    after each; null once all is undone. An undo without an edit does nothing.

    The depth is a walk that can't fall below 0: the running sum of +1 and -1 less its lowest value so far. The edit on top is
    the last one that reached the depth: one of a higher depth has been undone, and those after it at this depth replaced it.
    """
    until = Window.partitionBy("path").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.withColumn("walk", F.sum(F.when(F.col("kind") == "edit", 1).otherwise(-1)).over(until))
    rows = rows.withColumn("depth", F.col("walk") - F.least(F.lit(0), F.min("walk").over(until))).drop("walk")
    at_depth = Window.partitionBy("path", "depth").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("kind") == "edit", F.struct("content")), ignorenulls=True).over(at_depth)["content"]
    return rows.withColumn("shown", F.when(F.col("depth") > 0, top))
