"""What a stream reports of itself, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls `report` with a dict for each batch of any stream: its name, batch, rows, rates and seconds."""

    def __init__(self, report: Callable[[dict], None]) -> None:
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "seconds": (p.batchDuration or 0) / 1000})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report({"query": None, "batch": None, "error": event.exception})
