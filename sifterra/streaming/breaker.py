"""A circuit breaker over a stream of answers, in keyed state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Breaker(StatefulProcessor):
    def __init__(self, key: str, order: str, error: str, limit: int) -> None:
        self.key, self.order, self.error, self.limit = key, order, error, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values(self.order, kind="stable")
        n = self.run.get()[0] if self.run.exists() else 0
        count, halted = [], []
        for e in batch[self.error].tolist():
            halted.append(n >= self.limit)
            n = n if n >= self.limit else n + 1 if e else 0
            count.append(n)
        self.run.update((n,))
        yield pd.DataFrame({self.key: batch[self.key], self.order: batch[self.order], "in_a_row": count, "halted": halted})

    def close(self) -> None:
        pass


def breaker(answers: DataFrame, key: str, order: str, error: str, limit: int = 5) -> DataFrame:
    """(key, order, in_a_row, halted) of each answer of a stream.

    ``in_a_row`` counts the errors up to this answer without a good one between, over
    batches and restarts; once it is ``limit`` the key is halted, its count stands, and all
    its later answers are ``halted``: they are not to be counted, and nothing more is to be
    asked.  Within a batch answers count by ``order`` (its ties: as they come); batches come
    in the order of the source.  A null error is none.  A key's answers of one batch are
    held by one task: bound them with the source's trigger options.  The session's state
    store must be that of ``STORE``.
    """
    kinds = {c: answers.schema[c].dataType.simpleString() for c in (key, order)}
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, in_a_row long, halted boolean"
    picked = answers.selectExpr(f"`{key}`", f"`{order}`", f"coalesce(`{error}`, false) as `{error}`")
    return picked.groupBy(key).transformWithStateInPandas(_Breaker(key, order, error, limit), schema, outputMode="Append", timeMode="None")
