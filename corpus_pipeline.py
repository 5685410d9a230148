"""The corpus pipeline: language ID, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailgrid.llm import credentials, langid, packing, partenum
from hailgrid.llm.common import bounded_batches, table
from hailgrid.session import materialize

# A document whose best language scores less is taken for none of the learned ones. With L languages no best score is
# under 1/L, so what resembles none of a few is told by langid's floors.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that resemble no learned language; fills in a missing lang.

    Where no row is labelled nothing can be learned, and only documents without letters go. Further columns are kept, whatever their names.
    """
    bounded_batches(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # all columns but the text travel as one, so that none can clash with what the classifier adds
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    told = langid.predict(docs.select("text", rest.alias("_doc")), model, resembling=True)
    told = told.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    doc = F.col("_doc")
    own = {"text": F.col("text"), "lang": F.coalesce(doc["lang"], F.col("lang_pred"))}
    return told.select(*[own.get(c, doc[c]).alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    bounded_batches(spark)
    return partenum.keep_one(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every reported secret; no document goes."""
    return credentials.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens; one row per piece."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

# SQL expresses neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
