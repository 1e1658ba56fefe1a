"""Expectations on streams (O-88): the rules of ``operators.quality.validate``, judged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from featurespark.operators.quality import Expectation, judged


class ExpectationLog(StreamingQueryListener):
    """Writes a row for each rule and micro-batch of streams made by ``expect`` under its name.

    Rows lie under the batch's id, so a batch that runs again replaces its own. A batch without rows has a row for each
    rule too: its counts are 0, its other values null.
    """

    def __init__(self, spark: SparkSession, name: str, expectations: list[Expectation], path: str):
        self.spark, self.name, self.expectations, self.path = spark, name, expectations, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        rows = [(c, statistic, seen[f"_o{i}"], seen[f"_s{i}"]) for i, (c, statistic, *_) in enumerate(self.expectations)]
        made = self.spark.createDataFrame(rows, "column_name string, statistic string, observed double, success boolean")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch_id={event.progress.batchId}")

    def wait(self) -> None:
        """Until what has happened so far is written."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # noqa: SLF001


def expect(stream: DataFrame, expectations: list[Expectation], path: str, name: str = "expectations") -> tuple[DataFrame, ExpectationLog]:
    """(stream, log): the rows as they are, judged in the pass that they make anyway.

    The log listens to the session's streams until ``spark.streams.removeListener(log)``.
    """
    log = ExpectationLog(stream.sparkSession, name, list(expectations), path)
    stream.sparkSession.streams.addListener(log)
    made = []
    for i, (_, _, value, success) in enumerate(judged(expectations)):
        made += [value.alias(f"_o{i}"), success.alias(f"_s{i}")]
    return stream.observe(name, *made), log


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, column_name, statistic, observed, success."""
    rows = spark.read.schema("column_name string, statistic string, observed double, success boolean, batch_id long").option("basePath", path)
    return rows.parquet(f"{path}/batch_id=*").select("batch_id", "column_name", "statistic", "observed", "success")
