"""Tables that a plan reads several times, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: it is computed once, and a lost executor costs nothing.

    The folder is that of ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files once no plan refers to them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(path)
    return df.checkpoint()
