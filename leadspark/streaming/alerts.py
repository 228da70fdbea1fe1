"""An alert when a lead looks at the pricing page for the third time, as events arrive in any order.

State per lead is its first few views by event time. An alert leaves as soon as the wanted view is known, and again
with the next revision if an earlier view arrives late. Once the watermark passes the alert no earlier view can come, and the
state goes. So alerts are prompt, and the last revision of each is what a batch over all events finds.

Leads are followed by groups, dealt by a hash: a call of Python has a price of its own, so there is one for many leads.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Leads per group grow with the data; give more groups for more executors.
GROUPS = 1024
NEVER = 2**63 - 1

# The functions below travel to the executors by value, so those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pricing_alerts(interactions: DataFrame, nth: int = 3, delay: str = "7 days", groups: int = GROUPS) -> DataFrame:
    """(lead_id, interaction_id, alert_at, revision) of a stream of interactions; ``alert_at`` in microseconds.

    Events later than ``delay`` behind the latest are not waited for. Rows without a lead, a time or an id take no part.
    Views count by time, then id; a view that arrives twice counts once.
    """
    views = interactions.where("page_name = 'Pricing' AND lead_id IS NOT NULL AND ts IS NOT NULL AND interaction_id IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in interactions.schema.fields}
    views = views.select("lead_id", "interaction_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", delay)
    views = views.withColumns({"micros": F.unix_micros("at"), "group": F.pmod(F.xxhash64("lead_id"), F.lit(groups)).cast("int")})

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known = {lead: (list(zip(times, ids)), *rest) for lead, times, ids, *rest in zip(*state.get)} if state.exists else {}
        met: dict[object, list] = {}
        for batch in () if state.hasTimedOut else batches:
            views: dict[object, set] = {}
            for lead, at, number in zip(batch["lead_id"].tolist(), batch["micros"].tolist(), batch["interaction_id"].tolist()):
                views.setdefault(lead, set()).add((at, number))
            for lead, own in views.items():
                first = met[lead] if lead in met else known[lead][0] if lead in known else []
                met[lead] = sorted(own.union(first))[:nth]
        found = []
        for lead, first in met.items():
            old, revision, _ = known.get(lead, ([], 0, NEVER))
            before, after = (x[nth - 1] if len(x) >= nth else None for x in (old, first))
            if after != before:
                revision += 1
                found.append((lead, after[1], after[0], revision))
            # in milliseconds; the state is of no use once no earlier view can come
            until = NEVER if after is None else max(after[0] // 1000 + 1, watermark + 1)
            known[lead] = (first, revision, until)
        known = {lead: kept for lead, kept in known.items() if kept[2] >= watermark}
        if known:
            firsts, revisions, untils = (list(x) for x in zip(*known.values()))
            state.update((list(known), [[t for t, _ in x] for x in firsts], [[i for _, i in x] for x in firsts], revisions, untils))
            if min(untils) < NEVER:
                state.setTimeoutTimestamp(max(min(untils), watermark + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["lead_id", "interaction_id", "alert_at", "revision"])

    return views.groupBy("group").applyInPandasWithState(
        follow,
        outputStructType=f"lead_id {kinds['lead_id']}, interaction_id {kinds['interaction_id']}, alert_at long, revision int",
        stateStructType=f"leads array<{kinds['lead_id']}>, times array<array<long>>, ids array<array<{kinds['interaction_id']}>>, revisions array<int>, untils array<long>",
        outputMode="update",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )


def write_alerts(alerts: DataFrame, out_path: str, checkpoint_path: str) -> StreamingQuery:
    """Every revision, a folder per batch: a batch that is tried again overwrites its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return alerts.writeStream.outputMode("update").option("checkpointLocation", checkpoint_path).trigger(availableNow=True).foreachBatch(write).start()


def current_alerts(spark: SparkSession, out_path: str) -> DataFrame:
    """The last revision of each alert: (lead_id, interaction_id, alert_at)."""
    written = spark.read.parquet(out_path)
    last = F.row_number().over(W.partitionBy("lead_id").orderBy(F.desc("revision")))
    at = F.timestamp_micros("alert_at").cast(T.TimestampNTZType())
    return written.withColumn("_last", last).where("_last = 1").select("lead_id", "interaction_id", at.alias("alert_at"))
