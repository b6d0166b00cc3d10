"""Totals gathered while rows are written, so that no second job reads them again."""

import logging

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from postlake import vocab

log = logging.getLogger(__name__)


def run_totals() -> dict[str, Column]:
    """Outcomes by status, and the roles, tokens and requests they took."""
    status = {s: F.count_if(F.col("status") == s) for s in vocab.RUN_STATUSES}
    sums = {"roles": "role_count", "tokens_in": "tokens_in", "tokens_out": "tokens_out", "requests": "requests"}
    return status | {name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint") for name, c in sums.items()}


def detail_totals(html="description_html") -> dict[str, Column]:
    return {"cards": F.count("*"), "missing": F.count_if(F.col(html).isNull())}


def change_totals() -> dict[str, Column]:
    return {c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint") for c in ("inserted", "updated", "unchanged")}


class Totals:
    """Aggregates of one frame, known once a job has written it: ``on`` puts them in its plan, ``get`` gives them.

    A row counts once for each time the plan runs to its end, so only the frame that is written should carry them.
    """

    def __init__(self, aggregates: dict[str, Column]):
        self._aggregates, self._observation = aggregates, Observation()

    def on(self, df: DataFrame) -> DataFrame:
        return df.observe(self._observation, *[c.alias(n) for n, c in self._aggregates.items()])

    def get(self) -> dict:
        try:
            found = self._observation.get
        except Py4JJavaError:  # the optimiser saw that there are no rows, and left nothing to observe
            found = {}
        return {n: found.get(n) or 0 for n in self._aggregates}


class RunningTotals(StreamingQueryListener):
    """What all micro-batches so far sum up to: the totals a stream observes under ``name``, told after each batch.

    ``tell`` takes the number of the batch and the sums; by default they go to the log.
    """

    def __init__(self, name: str, tell=None):
        self.name, self.sums, self._seen = name, {}, set()
        self._tell = tell or (lambda batch, sums: log.info("%s, batch %d: %s", name, batch, sums))

    def add(self, run: str, batch: int, found: dict) -> None:
        """Count the totals of a batch; one that is told twice counts once."""
        if (run, batch) not in self._seen:
            self._seen.add((run, batch))
            for key, value in found.items():
                self.sums[key] = self.sums.get(key, 0) + (value or 0)
            self._tell(batch, dict(self.sums))

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.add(str(event.progress.id), event.progress.batchId, found.asDict())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
