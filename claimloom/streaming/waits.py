"""How long what was routed waits for its decision, as a join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def waits(routed: DataFrame, decided: DataFrame, key: str, at: str, event: str, longest: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(key, routed_event, routed_at, decided_event, decided_at, wait_s): each routing with each decision on its key within `longest`, and once
    with nulls if there is none.

    On streams, the state of both sides is dropped once the watermark, `late` behind the latest event of either, has passed what can still
    meet, and rows with nulls come out then; what comes later than that is left out. To let go of the last ones of a quiet stream, give both sides a
    heartbeat: a late event with a key that no other has (not null, for those never reach the join) and a null event; its row, without a routed_event, is the
    reader's to leave out. On tables the same rows come at once. Null keys meet nothing."""
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.col(event).alias(f"{name}_event"), F.col(at).cast("timestamp").alias(f"{name}_at"))
    a, b = side(routed, "routed"), side(decided, "decided")
    if routed.isStreaming:
        a, b = a.withWatermark("routed_at", late), b.withWatermark("decided_at", late)
    meet = F.expr(f"routed_key = decided_key AND decided_at >= routed_at AND decided_at <= routed_at + INTERVAL {longest}")
    seconds = (F.unix_micros("decided_at") - F.unix_micros("routed_at")) / 1e6
    return a.join(b, meet, "left").select(F.col("routed_key").alias(key), "routed_event", "routed_at", "decided_event", "decided_at", seconds.alias("wait_s"))


def last_routed(pairs: DataFrame) -> DataFrame:
    """Of waits(), the one of each decision since its last routing."""
    last = F.max_by(F.struct(*pairs.columns), F.struct("routed_at", "routed_event"))
    return pairs.where("decided_event IS NOT NULL").groupBy("decided_event").agg(last.alias("_last")).select("_last.*")
