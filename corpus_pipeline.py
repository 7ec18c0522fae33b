"""From raw documents to packed training sequences, one operator of framelake.llm per stage.

STAGES: (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents."""
from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import bound_batches, new_folder
from framelake.llm.language import NONE, fit_languages, identify_languages, in_fold
from framelake.llm.packing import pack_documents
from framelake.llm.quality import fit_quality, score_quality
from framelake.llm.simhash import keep_one_of_each
from framelake.llm.substrings import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bounded(stage):
    """A stage that bounds the batches of texts its workers get, also where it is run by itself and not by run()."""
    @functools.wraps(stage)
    def with_bound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)
    return with_bound


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows of the fitting folds. Null and empty
    texts are scored as one empty passage, repeated rows alike. If a label has no document, nothing can be learned and all
    documents stay; an empty table gives none."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").where(~in_fold())
    model = fit_quality(docs.where(~in_fold()), labels)
    return score_quality(docs, model, keep=COLUMNS).where("predicted = 1").select(COLUMNS) if model.learned else docs.select(COLUMNS)


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go, null and empty texts among them. If no row names its
    language, nothing can be learned and all documents stay; an empty table gives none."""
    model = fit_languages(docs.where(~in_fold()))
    return identify_languages(docs, model, keep=COLUMNS).where(F.col("lang_pred") != NONE).select(COLUMNS) if model.languages else docs.select(COLUMNS)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles and a similarity of 0.8: that with the smallest
    doc_id. Null, empty and blank texts have no shingle and are one group; whole texts are compared, however long; an empty
    table gives none."""
    return keep_one_of_each(docs.select(COLUMNS), similarity=0.8, shingle=5)


@bounded
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or the same one, already has. A document of which nothing is
    left stays with an empty text."""
    return dedup_substrings(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts in sequences of at most 1024 tokens. A null or empty text is its end mark alone, a longer one is cut; repeated
    rows are each packed; an empty table gives none."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_pieces=False)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]
#: The classifiers and the fingerprints have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of sf_dir; tables between stages lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = new_folder(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
