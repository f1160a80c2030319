"""What running queries drop and keep: late rows, and the rows of their state stores."""

from __future__ import annotations

import json
import threading
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Rows that queries dropped because the watermark had passed them, per query and stateful operator.

    ``spark.streams.addListener(late)`` before the queries start. An operator counts what reaches it: a
    window aggregation each late row once per window that is closed and, where several rows were added up
    before the shuffle, their sum once; a stateful processor every row once. So ``rows`` takes a query's
    processors where it has any, and the largest count of its other operators otherwise.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._dropped: dict[str, Counter] = defaultdict(Counter)
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            self._names.setdefault(str(progress.id), progress.name or str(progress.id))
            for place, operator in enumerate(progress.stateOperators):
                if operator.numRowsDroppedByWatermark:
                    self._dropped[str(progress.id)][place, operator.operatorName] += operator.numRowsDroppedByWatermark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def by_operator(self, query: str) -> dict[tuple[int, str], int]:
        """Dropped rows by place and name of the stateful operator, for a query's id."""
        with self._lock:
            return dict(self._dropped[query])

    def rows(self, query: str) -> int:
        """Late rows of a query, by its id."""
        dropped = self.by_operator(query)
        once = [n for (_, name), n in dropped.items() if name.startswith("transformWithState")]
        return max(once or dropped.values(), default=0)

    def totals(self) -> dict[str, int]:
        """Late rows of all queries seen, by name."""
        with self._lock:
            names = dict(self._names)
        return {name: self.rows(query) for query, name in names.items()}


def state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Everything a query remembers as of its last batch: (operator, name, variable, key, value), the last two as JSON.

    Read from the checkpoint, whether or not the query runs; nothing is collected.
    """
    stores = spark.read.format("state-metadata").load(checkpoint).orderBy("operatorId").collect()
    parts = []
    for store in stores:
        for variable in _variables(store):
            reader = spark.read.format("statestore").option("operatorId", store["operatorId"])
            reader = reader.option("storeName", store["stateStoreName"])
            if variable:
                reader = reader.option("stateVarName", variable)
            rows = reader.load(checkpoint)
            about = [F.lit(store["operatorId"]).alias("operator"), F.lit(store["operatorName"]).alias("name")]
            parts.append(
                rows.select(*about, F.lit(variable).cast("string").alias("variable"), F.to_json("key").alias("key"), F.to_json("value").alias("value"))
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _variables(store) -> list[str | None]:
    """The named states of a stateful processor; other operators have one without a name."""
    if not store["operatorName"].startswith("transformWithState"):
        return [None]
    states = json.loads(store["operatorProperties"])["stateVariables"]
    names = [s["stateName"] for s in states]
    return [n for n in names if not n.startswith("$")]  # timers are no state of the processor's own
