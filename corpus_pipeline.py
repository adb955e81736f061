"""A corpus pipeline of five stages; each works on all that the one before it kept.

toxicity: documents that the grammar rejects go. near_duplicates: of documents whose five-word shingles have a
similarity of 0.8 or more, directly or through others, one stays, that with the group's smallest id. decontamination: documents that hold windows of two benchmark items or
more go, and hits are cut out of the others. pii: personal data is replaced by its kind. packing: what is left is
tokenized and packed into sequences, a row for each piece, with its ids.

Stages but the last return the columns of documents; n_chars follows the text. Texts of all lengths go through,
null and empty ones too. Documents with a null id, or with one id, are near-duplicates only if their texts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import free_name
from eventloom.llm.decontaminate import remove_contamination
from eventloom.llm.packing import pack
from eventloom.llm.pii import redact
from eventloom.llm.queries import read, tokenizer_files
from eventloom.llm.simhash import keep_one_of_similar
from eventloom.llm.toxicity import score_toxicity, train
from eventloom.shared import materialize


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    name = free_name(docs, "score")
    return score_toxicity(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(remove_contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, **tokenizer_files())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: The stages are tested against brute force; SQL has no words for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
