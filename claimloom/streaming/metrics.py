"""Counters, gauges and a histogram of a stream, observed in the pass that it makes anyway, and their text for a scraper."""

from __future__ import annotations

import math
import threading
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "claimloom"
#: Upper bounds of a histogram's buckets, in seconds.
BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)


def observed(df: DataFrame, counters: dict[str, Column] | None = None, value: Column | None = None, bounds: tuple[float, ...] = BOUNDS, name: str = NAME) -> DataFrame:
    """df, which reports with each batch how many rows each condition of `counters` holds for, and of a value its count, sum and
    cumulative buckets: how many are at most each bound. Nulls count nowhere. No further pass or shuffle is made for it."""
    found = [F.count_if(condition).alias(f"counter_{n}") for n, condition in (counters or {}).items()]
    found.append(F.count(F.lit(1)).alias("rows"))
    if value is not None:
        v = value.cast("double")
        found += [F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum")]
        found += [F.count_if(v <= F.lit(b)).alias(f"bucket_{k}") for k, b in enumerate((*bounds, math.inf))]
    return df.observe(name, *found)


class Totals(StreamingQueryListener):
    """Adds up what streams observe. A batch that is run again replaces what it reported before, so that it counts once.

    Only sums of batches come to the driver, of which the last `keep` are kept one by one; earlier ones cannot come again."""

    def __init__(self, bounds: tuple[float, ...] = BOUNDS, name: str = NAME, keep: int = 100) -> None:
        self.bounds, self.name, self.keep = bounds, name, keep
        self.batches: dict[tuple[str, int], dict] = {}
        self.past: dict[str, float] = {}
        self.gauges: dict[str, float] = {}
        self._lock = threading.Lock()

    def add(self, query: str, batch: int, found: dict) -> None:
        with self._lock:
            self.batches[query, batch] = found
            for old in sorted(k for k in self.batches if k[0] == query)[: -self.keep]:
                for n, v in self.batches.pop(old).items():
                    self.past[n] = self.past.get(n, 0) + v

    def totals(self) -> dict[str, float]:
        with self._lock:
            out = dict(self.past)
            for found in self.batches.values():
                for n, v in found.items():
                    out[n] = out.get(n, 0) + (v or 0)
        return out

    def gauge(self, name: str, value: float) -> None:
        """Set what is counted elsewhere, such as a queue's depth."""
        self.gauges[name] = value

    def take(self, progresses: Iterable) -> Totals:
        """Add the progress reports of a query, for one that has ended; a listener gets them as they come."""
        for p in progresses:
            row = (p.observedMetrics or {}).get(self.name)
            if row is not None:
                self.add(str(p.id), p.batchId, row.asDict())
        return self

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.take([event.progress])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def histogram(self) -> list[tuple[float, int]]:
        """(bound, rows of at most that), the last bound being infinite."""
        found = self.totals()
        return [(b, int(found.get(f"bucket_{k}", 0))) for k, b in enumerate((*self.bounds, math.inf))]

    def exposition(self, prefix: str = NAME) -> str:
        """The totals in the text format that scrapers of metrics read."""
        found = self.totals()
        lines = []
        for n in sorted(found):
            if n.startswith("counter_"):
                full = f"{prefix}_{n.removeprefix('counter_')}_total"
                lines += [f"# TYPE {full} counter", f"{full} {found[n]:g}"]
        if "count" in found:
            full = f"{prefix}_seconds"
            lines.append(f"# TYPE {full} histogram")
            lines += [f'{full}_bucket{{le="{"+Inf" if math.isinf(b) else format(b, "g")}"}} {n}' for b, n in self.histogram()]
            lines += [f"{full}_sum {found['sum']:g}", f"{full}_count {found['count']:g}"]
        for n, v in sorted(self.gauges.items()):
            lines += [f"# TYPE {prefix}_{n} gauge", f"{prefix}_{n} {v:g}"]
        return "\n".join([*lines, ""])
