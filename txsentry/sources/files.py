"""File sources and sinks.

All reads use explicit schemas (no inference pass over the data); all
writes are single atomic Spark jobs.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentry.schema import LABELLED, LABELLED_ORDER, RAW_TRANSACTION, TRANSACTION

# Text formats keep event time to the microsecond.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
CSV_OPTIONS = {"header": "true", "timestampFormat": TS_FORMAT}


def read_first_existing(spark: SparkSession, paths: Iterable[str], reader) -> DataFrame:
    """``reader(path)`` on the first path that exists (e.g. a refined v2 file
    before the v1 file)."""
    errors = []
    for p in paths:
        try:
            df = reader(p)
            df.schema  # resolves the path
            return df
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            errors.append(p)
    raise FileNotFoundError(f"none of {errors} exists")


def read_labelled_csv(spark: SparkSession, paths: Iterable[str] | str) -> DataFrame:
    """Labelled transactions from CSV with the fixed schema."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return read_first_existing(
        spark, paths,
        lambda p: spark.read.schema(LABELLED).options(**CSV_OPTIONS).csv(p))


def write_labelled_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Labelled transactions to CSV, columns in the fixed file order."""
    df.select(*LABELLED_ORDER).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Request rows from CSV as text, by the header's names: malformed values
    reach the validation rules instead of becoming null."""
    df = spark.read.option("header", "true").csv(path)
    return df.select(*[c for c in df.columns if c in RAW_TRANSACTION.names])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text file at ``path``, on whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file, None where there is none."""
    try:
        return spark.read.text(path, wholetext=True).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_transactions_json(spark: SparkSession, path: str, multi_line: bool = False,
                           labelled: bool = False, raw: bool = False) -> DataFrame:
    """Transaction documents (JSON lines, or whole-file documents with
    ``multi_line``) with the fixed schema; ``raw`` keeps every field as text
    for validation (malformed values reach the rules instead of becoming null)."""
    schema = RAW_TRANSACTION if raw else (LABELLED if labelled else TRANSACTION)
    return (spark.read.schema(schema).option("multiLine", multi_line)
            .option("timestampFormat", TS_FORMAT).json(path))


def write_transactions_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("timestampFormat", TS_FORMAT).json(path)


def _text(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def from_records(spark: SparkSession, records: Mapping | Iterable[Mapping]) -> DataFrame:
    """Request payloads (one dict or a list of dicts) as raw request text;
    missing fields are null.  Validation/normalisation types them.  Meant
    for request-sized inputs built on the driver."""
    rows = [records] if isinstance(records, Mapping) else list(records)
    names = RAW_TRANSACTION.fieldNames()
    data = [tuple(_text(r.get(n)) for n in names) for r in rows]
    return spark.createDataFrame(data, RAW_TRANSACTION)


def write_metadata(spark: SparkSession, meta: Mapping, path: str) -> DataFrame:
    """Persist a run summary as one JSON document; returns it read back."""
    text = json.dumps(meta, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1) \
         .write.mode("overwrite").text(path)
    return spark.read.json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
