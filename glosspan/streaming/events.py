"""What becomes of streaming queries, as events in a fixed order.

A batch with rows tells that the list of documents has changed, then which
resource; a query that ends, by itself, by ``stop`` or by an error, tells so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

LISTED, UPDATED, STOPPED = "list_changed", "updated", "stopped"


class Announcer(StreamingQueryListener):
    """Calls ``tell(event, details)`` for one query, known by its id or, before it has one, by its name."""

    def __init__(self, tell: Callable[[str, dict], None], name: str | None = None, done: Callable[[], None] = lambda: None):
        self.tell, self.name, self.done = tell, name, done
        self.run: str | None = None

    def follow(self, run) -> None:
        self.run = str(run)

    def onQueryStarted(self, event) -> None:
        if self.run is None and self.name is not None and event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.runId) == self.run and progress.numInputRows:
            details = {"batch": progress.batchId, "rows": progress.numInputRows}
            self.tell(LISTED, details)
            self.tell(UPDATED, details)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.tell(STOPPED, {"error": event.exception})
            self.done()
