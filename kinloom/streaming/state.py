"""Counts by last status that go up and down as statuses change, from keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, was string, status string"


def changes(log: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """A row (key, was, status) whenever a key's last status changes in a batch; `was` is null at first.

    Rows that come late, with a smaller order than the state has seen, change nothing."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, seen = state.get if state.exists else (None, None)
        now, at = was, seen
        for pdf in batches:
            best = pdf.loc[pdf[order].idxmax()]
            if at is None or best[order] > at:
                now, at = str(best[status]), int(best[order])
        state.update((now, at))
        yield pd.DataFrame([(str(k[0]), was, now)] if now != was else [], columns=["key", "was", "status"])

    return log.groupBy(key).applyInPandasWithState(run, OUT, f"status string, {order} long", "update", GroupStateTimeout.NoTimeout)
