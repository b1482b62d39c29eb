"""The same operators over arriving data."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packlens.operators import rules
from packlens.operators.guidance import annotated_array
from packlens.session import delete_scratch, exists, recorded, scratch_path, settle

TERMINAL = ("done", "failed")


def stream_findings(arriving: DataFrame, out: str, checkpoint: str):
    """Declarations to one row per scan: verdict, warnings and annotated findings, nested. Each batch is evaluated and written once.

    All of it stays inside the declaration row, so the stream keeps no state; a repeated trigger overwrites itself.
    """

    def write(batch: DataFrame, version: int) -> None:
        nested = rules.with_results(batch).withColumn("results", annotated_array(F.col("results"), F.col("ocr_confidence")))
        rules.verdicts(nested, "results").write.mode("overwrite").parquet(f"{out}/batch={version}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_table(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).select("scan_id", "ocr_confidence", F.inline("results"))


def verdicts_table(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("results", "batch")


LATENESS, SLOTS, SPREAD = "2 days", 8, 16


def _count_open_days(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of the days of one slot, for one share of them: running totals while a day is open; what comes later is only passed on."""
    watermark = state.getCurrentWatermarkMs()
    is_open = lambda day: (datetime.combine(day, datetime.min.time(), UTC) + timedelta(days=1)).timestamp() * 1000 > watermark
    new = Counter()
    for batch in batches:
        new.update(batch["day"])
    held = {day: n for text, n in json.loads(state.get[0]).items() if is_open(day := date.fromisoformat(text))} if state.exists else {}
    rows = []
    for day, n in new.items():
        if is_open(day):
            held[day] = n = held.get(day, 0) + n
        rows.append((day, key[1], n, not is_open(day)))
    state.update((json.dumps({day.isoformat(): n for day, n in held.items()}),))
    yield pd.DataFrame(rows, columns=["day", "share", "n", "late"])


def stream_daily_volume(arriving: DataFrame, out: str, checkpoint: str, *, lateness: str = LATENESS):
    """Scans per UTC day (a tumbling window of a day in event time).

    A day closes once the watermark (newest time seen less ``lateness``) has passed its end. State is the totals of open days; days
    share ``SLOTS`` slots in turn, and a slot forgets its closed days when it is next used, so there are never more than ``SLOTS * SPREAD`` state rows. Rows
    of closed days are not dropped: their counts go to a side table (``out/late``), which ``daily_volume_table`` adds. A
    repeated trigger overwrites itself.
    """

    def write(batch: DataFrame, version: int) -> None:
        batch.persist()
        batch.where("NOT late").drop("late").coalesce(1).write.mode("overwrite").parquet(f"{out}/windows/batch={version}")
        batch.where("late").drop("late").coalesce(1).write.mode("overwrite").parquet(f"{out}/late/batch={version}")
        batch.unpersist()

    # A day's rows are dealt over shares by the task that read them, so that a busy day is not one group.
    seen = arriving.select("created_at").where("created_at IS NOT NULL").withWatermark("created_at", lateness)
    day = F.to_date("created_at")
    dealt = seen.select("created_at", day.alias("day"), F.pmod(F.unix_date(day), F.lit(SLOTS)).alias("slot"), (F.spark_partition_id() % SPREAD).alias("share"))
    counted = dealt.groupBy("slot", "share").applyInPandasWithState(
        _count_open_days, "day date, share int, n bigint, late boolean", "open string", "update", GroupStateTimeout.NoTimeout)
    return counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_volume_table(spark: SparkSession, out: str) -> DataFrame:
    """Counts per day. A share's total only grows, so its largest one is its last."""
    schema = "day date, share int, n bigint"
    open_ = spark.read.schema(schema).parquet(f"{out}/windows").groupBy("day", "share").agg(F.max("n").alias("n"))
    late = spark.read.schema(schema).parquet(f"{out}/late")
    return open_.select("day", "n").unionByName(late.select("day", "n")).groupBy("day").agg(F.sum("n").alias("n"))


def job_state(transitions: DataFrame) -> DataFrame:
    """First terminal and latest transition per job: all a job's state needs to know, with its error and scan."""
    step = F.struct("at", "event_id", "status", "error", "scan_id")
    end = F.when(F.col("status").isin(*TERMINAL), step)
    return transitions.groupBy("job_id").agg(F.min(end).alias("terminal"), F.max(step).alias("latest"))


def _current(states: DataFrame) -> DataFrame:
    return states.select("job_id", F.coalesce("terminal", "latest").alias("s")).select("job_id", "s.status", "s.error", "s.scan_id")


def job_status_latest(transitions: DataFrame) -> DataFrame:
    """Status per job; a terminal state never regresses."""
    return _current(job_state(transitions))


BUCKETS = 16


def _merged(states: DataFrame) -> DataFrame:
    return states.groupBy("job_id", "bucket").agg(F.min("terminal").alias("terminal"), F.max("latest").alias("latest"))


def stream_job_status(transitions: DataFrame, out: str, checkpoint: str, *, buckets: int = BUCKETS):
    """Job state as a table of hash buckets (``out``), each one file: a trigger reads, merges and replaces the buckets it touches.

    Merging takes the first terminal and the latest step, so a trigger that is repeated after a failure changes nothing more.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        with recorded() as paths:
            new = settle(job_state(batch).withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")), "states")
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
            old = spark.read.schema(new.schema).parquet(out).where(F.col("bucket").isin(touched)) if exists(spark, out) else new.limit(0)
            merged = settle(_merged(old.unionByName(new)), "merged")
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
        delete_scratch(spark, paths)

    return transitions.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_status_table(spark: SparkSession, out: str) -> DataFrame:
    return _current(spark.read.parquet(out))


def arriving(df: DataFrame, name: str, *, rows: int = 20_000, triggers: int = 4) -> DataFrame:
    """A table as a file stream: the tasks that make it write files of a bounded size, which arrive over about ``triggers`` triggers."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    files = len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // triggers))).parquet(path)
