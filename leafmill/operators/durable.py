"""Tables that are computed once and survive the loss of an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint, in the folder the session names or else in the warehouse."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)
