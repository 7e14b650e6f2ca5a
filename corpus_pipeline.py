"""Corpus pipeline: documents -> token ids, one operator per stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written and read again as the next stage's
``docs``.  All but the last return the columns of ``docs``.

Stages know the rows of ``docs`` by file and place in the file, as the scan
tells them, so whole texts are neither copied into scratch tables nor numbered;
``docs`` that is no plain read of files is written first.  A stage's scratch
tables are dropped when the next stage begins, as its result has been written
by then.

Defined cases, stage by stage: null texts are clean, keep their null, are one
group of SimHash fingerprint zero together with blank texts (one of them
stays), weigh nothing in the mix and encode to no ids; null ids, sources and
languages stay null; rows repeated with one id are rows of their own until
SimHash keeps one of each group; equal rows are told apart by their place; an
empty table stays empty through all stages; further columns are carried to the
mix, whatever their names.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from txsentry.llm import line_dedup, mixing, simhash, toxicity
from txsentry.llm import sentencepiece_lattice as lattice
from txsentry.llm.common import drop_scratch, fresh, owned_scratch, table, written

_scratch: dict[tuple, list[str]] = {}     # (application, tables, stage) -> its scratch tables


def _stage(number: int):
    """Owner of a stage's scratch tables."""
    def owner(fn):
        @wraps(fn)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir)
            drop_scratch(spark, _scratch.pop((*key, number - 1), []))
            with owned_scratch() as paths:
                out = fn(spark, docs, sf_dir)
            _scratch[*key, number] = paths
            return out
        return run
    return owner


def _placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that tell its rows apart at every read, and their names."""
    names = fresh(docs, "_file", "_at")
    place = [F.col(f"_metadata.{c}").alias(n) for c, n in zip(("file_name", "row_index"), names)]
    try:
        return docs.select("*", *place), names
    except AnalysisException:       # no plain read of files
        return written(docs, "stage-input").select("*", *place), names


@_stage(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject; fitted on the labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.rate(docs, model).filter("NOT rejected").select(*docs.columns)


@_stage(1)
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of three-line windows; ``n_chars`` follows the text."""
    placed, row = _placed(docs)
    kept = line_dedup.dedup_lines(placed, row=row)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


@_stage(2)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (three words, two bits)."""
    placed, row = _placed(docs)
    return simhash.keep_one(placed, row=row).select(*docs.columns)


@_stage(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    placed, row = _placed(docs)
    return mixing.mixed(placed, row=row).select(*docs.columns)


@_stage(4)
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken."""
    pieces = lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.encode_merges(docs, pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# Learned scores and random rounding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with owned_scratch() as now:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(spark, before)      # the table that this stage has read
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
