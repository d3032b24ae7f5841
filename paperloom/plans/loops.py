"""Cutting the lineage of loops.

A round's rows are checkpointed to the shared folder, so plans stay short and a
lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from paperloom.plans import shared


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows of one round, computed once; ``label`` names the round for the reader."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared.folder(df.sparkSession))
    return df.checkpoint()
