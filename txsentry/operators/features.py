"""Feature derivation (F10) and the fitted encoder/scaler.

``base_features`` is stateless and narrow.  ``FeatureEncoder`` is a Spark ML
``Estimator``; fitting it runs two aggregations over the training table: mean
and population std of the scaled columns, kept as model parameters, and the
dictionary of labels (``operators.labels``), a table of any size in the shared
folder.  ``FeatureModel.transform`` is arithmetic with literals and a hash
join per categorical column, without a shuffle of the rows as long as a
column's dictionary is small enough to broadcast.  Models persist with the ML
writer, the dictionary beside the parameters, and can sit in a
``PipelineModel``.
"""

from __future__ import annotations

import datetime as dt

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsentry.functions import features as FX
from txsentry.operators import labels as L
from txsentry.schema import CATEGORICAL_COLS, FEATURE_COLUMNS, SCALED_COLS
from txsentry.session import scratch_path

def _types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.typeName() for f in df.schema.fields}


def _default_ts(default_ts) -> Column:
    if default_ts is None:
        return F.current_timestamp()
    if isinstance(default_ts, (dt.datetime, str)):
        return F.lit(default_ts).cast("timestamp")
    return default_ts


def base_features(df: DataFrame, default_ts=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stateless features of raw or typed transactions.

    amount (clean), amount_log, hour, day_of_week, is_weekend,
    is_night_transaction, is_international, card_present (0/1) and the five
    categorical columns with ``unknown`` for missing.  Without a timestamp
    column the time features come from ``default_ts`` (wall clock if None);
    present but unparsable timestamps give hour 0 / day 0.
    """
    types = _types(df)
    if "timestamp" in df.columns:
        ts = FX.as_timestamp(F.col("timestamp"), types["timestamp"])
    else:
        ts = _default_ts(default_ts)
    amount = FX.amount_clean(F.col("amount"), types["amount"]) if "amount" in df.columns \
        else F.lit(0.0)
    carry = [c for c in dict.fromkeys(("transaction_id",) + tuple(keep)) if c in df.columns]
    out = df.select(
        *carry,
        amount.alias("amount"),
        FX.event_hour(ts).alias("hour"),
        FX.day_of_week(ts).alias("day_of_week"),
        *[(FX.bool_flag(F.col(b), types[b]) if b in df.columns else F.lit(0)).alias(b)
          for b in ("is_international", "card_present")],
        *[(FX.category_fill(F.col(c)) if c in df.columns else F.lit("unknown")).alias(c)
          for c in CATEGORICAL_COLS],
    )
    return out.withColumns({
        "amount_log": FX.amount_log(F.col("amount")),
        "is_weekend": FX.is_weekend(F.col("day_of_week")),
        "is_night_transaction": FX.is_night(F.col("hour")),
    })


class _ModelWriter(DefaultParamsWriter):
    """Parameters, and the dictionary beside them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        model = self.instance
        L.read(self.sparkSession, model.getOrDefault(model.dictionary)).write.partitionBy("column").parquet(f"{path}/dictionary")


class _ModelReader(DefaultParamsReader):
    def load(self, path: str) -> "FeatureModel":
        model = super().load(path)
        model._set(dictionary=f"{path}/dictionary")
        return model


class FeatureModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted label dictionary and scaling; ``transform`` yields the 12 features
    (DOUBLE, fixed order) plus ``features`` as a vector."""

    dictionary = Param(Params._dummy(), "dictionary", "path of the label table", TypeConverters.toString)
    sizes = Param(Params._dummy(), "sizes", "column -> labels, their bytes, fitted rows",
                  TypeConverters.identity)
    means = Param(Params._dummy(), "means", "scaled column -> mean", TypeConverters.identity)
    stds = Param(Params._dummy(), "stds", "scaled column -> population std",
                 TypeConverters.identity)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    keepCols = Param(Params._dummy(), "keepCols", "input columns carried through",
                     TypeConverters.toListString)

    @keyword_only
    def __init__(self, dictionary=None, sizes=None, means=None, stds=None, outputCol="features",
                 keepCols=None):
        super().__init__()
        self._setDefault(outputCol="features", keepCols=[])
        kwargs = self._input_kwargs
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def write(self):
        return _ModelWriter(self)

    @classmethod
    def read(cls):
        return _ModelReader(cls)

    def label_table(self, spark) -> DataFrame:
        """(label, code, n, column): label -> 0..k-1 in sorted order."""
        return L.read(spark, self.getOrDefault(self.dictionary))

    def scale_expr(self, column: str) -> Column:
        mean = self.getOrDefault(self.means)[column]
        std = self.getOrDefault(self.stds)[column]
        return (F.col(column) - F.lit(mean)) / F.lit(std if std else 1.0)

    def feature_columns(self, df: DataFrame, default_ts=None,
                        keep: tuple[str, ...] = ()) -> DataFrame:
        keep = tuple(self.getOrDefault(self.keepCols)) + tuple(keep)
        base = base_features(df, default_ts, keep=keep)
        carry = [c for c in base.columns if c not in FEATURE_COLUMNS and c != "amount"]
        enc = base.withColumns({c: self.scale_expr(c) for c in SCALED_COLS})
        enc = L.encode(enc, self.getOrDefault(self.dictionary), self.getOrDefault(self.sizes))
        return enc.select(*carry, *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.assemble(df)

    def assemble(self, df: DataFrame, default_ts=None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Feature columns plus the ``features`` vector (carrying ``keep``)."""
        feats = self.feature_columns(df, default_ts, keep)
        return VectorAssembler(inputCols=FEATURE_COLUMNS,
                               outputCol=self.getOrDefault(self.outputCol)).transform(feats)

    @staticmethod
    def feature_names() -> list[str]:
        return list(FEATURE_COLUMNS)


class FeatureEncoder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator for ``FeatureModel``.  There is no ``transform`` before fit:
    only the fitted model has one."""

    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    keepCols = Param(Params._dummy(), "keepCols", "input columns carried through",
                     TypeConverters.toListString)

    @keyword_only
    def __init__(self, outputCol="features", keepCols=None):
        super().__init__()
        self._setDefault(outputCol="features", keepCols=[])
        kwargs = self._input_kwargs
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> FeatureModel:
        """Two passes over the training rows: scaler statistics and labels."""
        base = base_features(df)
        stats = fit_scaler(base)
        path = scratch_path(df.sparkSession, "label-dictionary")
        return FeatureModel(dictionary=path, sizes=L.fit(base, CATEGORICAL_COLS, path), means=stats["mean"], stds=stats["std"],
                            outputCol=self.getOrDefault(self.outputCol),
                            keepCols=self.getOrDefault(self.keepCols))


def label_table(base: DataFrame) -> DataFrame:
    """(column, label, code, n): sorted distinct labels per categorical column."""
    return L.rank_labels(base, CATEGORICAL_COLS)


def _scaler_aggs() -> list:
    aggs = []
    for c in SCALED_COLS:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return aggs


def _scaler_dict(r) -> dict[str, dict[str, float]]:
    return {"mean": {c: float(r[f"{c}_mean"] or 0.0) for c in SCALED_COLS},
            "std": {c: float(r[f"{c}_std"] or 0.0) for c in SCALED_COLS}}


def scaler_stats(base: DataFrame) -> DataFrame:
    """One row: mean and population std of each scaled column."""
    return base.agg(*_scaler_aggs())


def fit_scaler(base: DataFrame) -> dict[str, dict[str, float]]:
    return _scaler_dict(scaler_stats(base).first())
