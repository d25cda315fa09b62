"""One reconciliation run: inputs, the previous analysis and the current one.

The analysis table is computed once per run and persisted (memory, spilling
to disk); every metric family reads it. A lost executor only loses cached
blocks, which Spark recomputes from the lineage. ``materialize`` cuts the
lineage instead by checkpointing into the cluster's shared checkpoint
folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit.operators.analyze import analyze
from settlekit.session import checkpoint_dir


@dataclass
class ReconRun:
    orders: DataFrame
    returns: DataFrame
    settlements: DataFrame
    run_ts: _dt.datetime
    previous: DataFrame | None = None          # previous analysis table
    previous_run_ts: _dt.datetime | None = None
    persist: bool = True
    _analysis: DataFrame | None = field(default=None, repr=False)

    @property
    def run_month(self) -> str:
        return self.run_ts.strftime("%Y-%m")

    @property
    def run_month_col(self):
        return F.lit(self.run_month)

    @property
    def analysis(self) -> DataFrame:
        if self._analysis is None:
            a = analyze(self.orders, self.returns, self.settlements, self.previous, self.run_ts)
            if self.persist:
                a = a.persist(StorageLevel.MEMORY_AND_DISK)
            self._analysis = a
        return self._analysis

    def materialize(self, spark: SparkSession) -> DataFrame:
        """Checkpoint the analysis into the shared checkpoint folder."""
        checkpoint_dir(spark)
        self._analysis = self.analysis.checkpoint(eager=True)
        return self._analysis

    def release(self) -> None:
        if self._analysis is not None:
            self._analysis.unpersist()
            self._analysis = None
