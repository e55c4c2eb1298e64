"""Trend plus residual as one Spark ML model: it transforms like any other, and saves and loads itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.operators.forecast import trend_value

#: The fitted line, carried from the state to the forecast.
LINE = ("slope", "intercept")


class TrendResidualModel(Model, HasPredictionCol, MLWritable, MLReadable):
    """Adds the forecast of each row: its series' fitted line, and the residual model's answer if there is one.

    ``state`` has a row per series with the line and whatever else was fitted for it; ``residual`` adds
    ``residual_pred`` from the columns of the row. Rows of a series without state are dropped. A row that carries
    the line already, because the state was joined before, is not joined again.
    """

    keyCols = Param(Params._dummy(), "keyCols", "columns that name a series", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, state: DataFrame | None = None, residual: PipelineModel | None = None, keyCols: Sequence[str] = ("series_id",),
                 predictionCol: str = "predicted_load_mw"):
        super().__init__()
        self.state, self.residual = state, residual
        self._set(keyCols=list(keyCols), predictionCol=predictionCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored, keys = dataset, self.getOrDefault(self.keyCols)
        if not set(LINE) <= set(dataset.columns):
            scored = dataset.join(self.state.select(*keys, *LINE), keys)
        if self.residual is None:
            return scored.withColumn(self.getPredictionCol(), trend_value()).drop(*LINE)
        total = trend_value() + F.col("residual_pred")
        return self.residual.transform(scored).withColumn(self.getPredictionCol(), total).drop(*LINE, "features", "residual_pred")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TrendResidualModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802 (Spark's name)
        # metadata last: a folder without it is no model
        self.model.state.write.parquet(f"{path}/state")
        if self.model.residual is not None:
            self.model.residual.write().save(f"{path}/residual")
        extra = {"has_residual": self.model.residual is not None}
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active(), extraMetadata=extra)


class _Reader(MLReader):
    def load(self, path: str) -> TrendResidualModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        residual = PipelineModel.load(f"{path}/residual") if metadata["has_residual"] else None
        model = TrendResidualModel(state=spark.read.parquet(f"{path}/state"), residual=residual)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
