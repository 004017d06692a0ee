"""Slots' chains of stages checked as they arrive, each slot by its own state.

The state of a slot is its last checkpoint: how many there were, its hash, the place of its stage, whether it ended the slot.
It lies in the stream's state store, so a stream that starts again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship
from .journal import STAGES

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StageMachine(StatefulProcessor):
    """Gives ``(slot, seq, error)`` for checkpoints that do not follow from those before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seen long, sha string, place int, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, sha, place, ended = self.last.get() if self.last.exists() else (0, None, 0, False)
        out = []
        for row in pd.concat(rows).sort_values("seq", kind="stable").itertuples(index=False):
            own = STAGES.index(row.stage) + 1 if row.stage in STAGES else 0
            previous = None if pd.isna(row.previous_sha) else row.previous_sha
            seen += 1
            if not own:
                error = "unknown stage"
            elif seen != row.seq:
                error = "sequence is not contiguous"
            elif previous != sha:
                error = "previous hash differs"
            elif ended:
                error = "event after the end"
            else:
                error = None if own == place + 1 else "stage out of order"
            if error:
                out.append((key[0], row.seq, error))
            sha, place, ended = (None if pd.isna(row.sha) else row.sha), own, bool(row.terminal) and not pd.isna(row.terminal)
        self.last.update((seen, sha, place, ended))
        yield pd.DataFrame(out, columns=["slot", "seq", "error"])

    def close(self) -> None:
        pass


def stage_errors_stream(checkpoints: DataFrame) -> DataFrame:
    """Breaks in the chains of a stream ``(slot, seq, stage, sha, previous_sha, terminal)``, whose slots' rows arrive in the order of ``seq``.

    The rules are those of ``journal.stage_errors``. Within a batch rows may stand in any order.
    The session's state store must be the one named ``STORE``.
    """
    ship(checkpoints.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in checkpoints.schema}
    schema = f"slot {kind['slot']}, seq {kind['seq']}, error string"
    return checkpoints.groupBy("slot").transformWithStateInPandas(StageMachine(), schema, "Append", "None")
