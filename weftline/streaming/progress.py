"""How far a stream has come, and how long its batches and saves took."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Tells ``say`` the share of ``total`` documents that came in and the milliseconds of each batch; keeps what it told in ``told``."""

    def __init__(self, total: int | None = None, say: Callable[[str], None] = print):
        self.total, self.say, self.rows, self.told = total, say, 0, []

    def onQueryStarted(self, event):
        self.rows = 0

    def onQueryProgress(self, event):
        p = event.progress
        self.rows += p.numInputRows
        share = 100 * self.rows / self.total if self.total else None
        self.told.append((p.batchId, self.rows, share, p.batchDuration))
        self.say(f"batch {p.batchId}: {self.rows} documents" + (f", {share:.1f} %" if share is not None else "") + f", {p.batchDuration} ms")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
