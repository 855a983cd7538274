"""Corpus pipeline: documents to a filtered, deduplicated, decontaminated, scrubbed and mixed set.

A null doc_id is one document in all decisions; rows that repeat a doc_id are a group of
near-duplicates and one of them stays.  An empty table gives an empty result, texts of any
length are read whole, and columns other than COLUMNS are ignored by every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.llm.decontaminate import contaminated
from asofspark.llm.mixing import mixed_rows
from asofspark.llm.near_copies import near_copy_groups
from asofspark.llm.pii import scrubbed
from asofspark.llm.quality_classifier import fit_quality, scored
from asofspark.llm.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a batch that goes to a Python worker, about: a batch of long documents needs no more memory than one of short ones.
BATCH_BYTES = 4 << 20


def _batched(stage):
    """A stage whose texts go to Python workers in batches of BATCH_BYTES; the setting stays, as the result is computed later."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id (null included) isn't among ``ids``."""
    gone = ids.select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


@_batched
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier predicts as good stay.

    A null or empty text is scored as one without words; repeated rows are decided alike.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select(*COLUMNS), model, keep=tuple(COLUMNS)).where("predicted = 1").select(*COLUMNS)


@_batched
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6's stage, on five-word shingles at a Jaccard similarity of 0.8: the document with the smallest doc_id of each group stays.

    Fingerprints within 2 bits don't reach such pairs, so candidates are texts whose balls of SimHash codes meet in one
    of several blocks; a ball flips the bits of least margin (see llm/near_copies.py).
    Null and empty texts are copies of each other; of a group whose doc_ids are equal or null, one row stays.
    Of rows with one doc_id, the first in the order of their columns stays; they are
    reduced by a grouped minimum, apart from the others.
    """
    docs = docs.select(*COLUMNS)
    groups = stored(near_copy_groups(docs))
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    repeated = stored(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    # Stored, so that Spark knows how few they are before it decides whether to shuffle the texts.
    kept = _without(docs, stored(gone.unionByName(repeated)))
    if repeated.isEmpty():
        return kept
    known = _without(repeated, gone).withColumnRenamed("doc_id", "_id")
    several = docs.join(known, docs["doc_id"].eqNullSafe(known["_id"]), "left_semi")
    first = several.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("_row"))
    return kept.unionByName(first.select("doc_id", "_row.*").select(*COLUMNS))


@_batched
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that contain an item of the benchmark go.

    Null and empty texts contain nothing and stay; rows with the doc_id of a document that goes, a null one included, go too.
    """
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs.select(*COLUMNS), stored(found.select("doc_id").distinct()))


@_batched
def scrub_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal data is replaced by its kind; n_chars follows the new text.

    A null text stays null, an empty one empty; every row is kept.
    """
    clean = scrubbed(docs, columns=("doc_id", "lang", "source"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


@_batched
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents that the mix takes, with size, target, epochs and taken.

    Texts without words (null and empty ones among them) have size 0 and aren't taken; a null source is a source of its own.
    """
    return mixed_rows(docs.select(*COLUMNS), keep=tuple(COLUMNS)).where("taken > 0")


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", scrub_pii),
    ("mixing", mix),
]
#: SQL can't express the classifier, the hashes or the random field; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
