"""Moves of files by arriving corrections, with the label that each file had before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.records import iso_utc, record_id
from ..operators.feedback import CORRECTION_METHOD, locate, valid_corrections
from ..schemas import CORRECTIONS

_STATE = "decision string"
_MOVED = "filename string, old_label string, new_label string, predicted_score double, reviewer string, at timestamp"
_STEPS = ["record_id", "decision", "predicted_score", "reviewer", "at", "dir", "label"]


def moves(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Real moves of one file among the corrections that have arrived, in time order; the state is its last decision."""
    rows = pd.concat([f[_STEPS] for f in frames]).sort_values(["at", "record_id"], kind="stable")
    last = state.get[0] if state.exists else None
    out = []
    for row in rows.itertuples(index=False):
        there, named = (last, last) if last is not None else (row.dir, row.label)
        if there != row.decision:
            out.append((key[0], named, row.decision, row.predicted_score, row.reviewer, row.at))
        last = row.decision
    state.update((last,))
    if out:
        yield pd.DataFrame(out, columns=["filename", "old_label", "new_label", "predicted_score", "reviewer", "at"])


def correction_stream(corrections: DataFrame, files: DataFrame, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the log of real moves, as ``apply_corrections`` has it, for a stream of corrections.

    ``corrections`` has ``record_id, filename, decision, predicted_score, reviewer, at``; ``files`` is a table at rest with
    ``filename, dir``, which says where a file is before its first correction. A file's last decision is kept as
    state, one short row for each file, so a later batch logs the label that an earlier one gave. Within a batch
    corrections are taken in time order, across batches as they arrive. Each correction is taken once, also
    after a restart from the checkpoint. Bad decisions and files that are nowhere are left out.
    """
    decided, _ = valid_corrections(corrections)
    places = locate(files, files.select("filename").distinct()).filter("dir IS NOT NULL").select("filename", "dir", "label")
    rows = decided.join(places, "filename").select("filename", *_STEPS)
    moved = rows.groupBy("filename").applyInPandasWithState(moves, _MOVED, _STATE, "append", GroupStateTimeout.NoTimeout)
    log = moved.select(
        record_id(F.col("at"), F.col("filename")).alias("record_id"), "filename", "old_label", "new_label", "predicted_score", "reviewer",
        F.lit(CORRECTION_METHOD).alias("method"), F.lit("applied").alias("apply_status"),
        iso_utc(F.col("at")).alias("applied_at"), iso_utc(F.col("at")).alias("created_at"),
    ).select(*CORRECTIONS.names)
    writer = log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", output)
    return (writer.trigger(availableNow=True) if once else writer).start()
