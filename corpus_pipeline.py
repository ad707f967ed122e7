"""A corpus pipeline over ``documents``: five stages, each over all that the one before kept.

``run`` writes each stage's result as Parquet in the shared folder, reads it again and deletes it after the next stage.

Rows with a null or empty text pass toxicity (scored by the bias), near-duplicates (linked with nothing), secrets and
mixing (no tokens, so nothing to thin out), and are encoded as no tokens. Of rows that repeat a key near-duplicates keeps one;
rows with a null key stay. Empty tables, tables without any text and tables without labels go through all stages; where
nothing tells domains apart, mixing keeps all that is there. Columns beyond those of ``documents`` are carried along up to the
last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, neardup, secrets, toxicity
from ledgerloom.llm.common import discard, table, written
from ledgerloom.llm.queries import tokenizer_path

#: Documents that score as high are rejected.
TOXIC_FROM = 0.7
#: Shares of tokens by domain. Toxic documents have gone by then, so they are no domain here.
WEIGHTS = {"good": 0.95, "poor": 0.05}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out_col="__toxicity").where(F.col("__toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Meets the weights by thinning out what is too much, over the documents that are left; none comes twice.

    Where the weights cannot be met, all documents stay.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), WEIGHTS, total=None, most_rate=1.0, only_first_rises=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path(), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_domains),
    ("bpe", encode),
]

#: Learned scores and hashed sketches are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return docs
