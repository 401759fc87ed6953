"""Cutting lineage between the stages of the offline build, and joins of tables that grow."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder that the cluster names, so that later uses neither plan nor compute it again."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="meridia-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt by its keys, never broadcast.

    Spark's estimates don't count what explode() adds, and a checkpoint keeps them: a table of millions of edges passes for a
    small one, and its broadcast would take all of it through the driver."""
    return df.hint("merge")
