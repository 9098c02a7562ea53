"""A corpus from raw documents to packed sequences, in five stages.

A stage is a function of (spark, docs, sf_dir); it works on all that the stage before has kept and
returns the columns of documents, but for the last, which returns the pieces of the packed sequences.
A text that a stage changes has its n_chars counted anew.

Cases, by stage: a null, empty or blank text goes with the quality rules; a later stage that is given one keeps it as
one of a group (near dedup), leaves it (pseudonyms), never takes it (mixing) or packs its closing id alone
(packing). A null doc_id is kept, and comes last where the least doc_id decides. A null source is a source of its
own. Repeated rows: near dedup leaves one. Ties are broken by hashes of the text. Very long texts are handled
whole. An empty table gives an empty table. Further columns stay as they are until packing, which reads none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import line_rules, mixing, packing, pseudonyms, similar
from gradeloom.llm.common import dropped, read_documents, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much or fail as a whole."""
    return _counted(line_rules.clean_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by the similarity of their 5-word shingles, stays."""
    return similar.drop_similar(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms."""
    return _counted(pseudonyms.mask_documents(docs, pseudonyms.key_of(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return _counted(mixing.mix_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("pseudonyms", pseudonymise),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Keyed permutations and the tokenizer are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, table = read_documents(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, before = written(docs), table  # in the shared folder, read back by the next stage
            if before is not None:
                dropped(before)
            table = docs
    return docs
