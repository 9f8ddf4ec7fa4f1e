"""The corpus pipeline: five stages over documents, each the next one's input as a written table.

Toxic documents go, cross-site boilerplate lines are cut, one document of each near-duplicate class
stays, documents with benchmark passages go, and the rest is packed into training sequences.

Defined results, for every stage: an empty table gives an empty result; columns beyond those of
documents are kept by all stages but the last, whatever their names; texts of any length are read
whole. Toxicity scores null and empty texts below 0.5, so they stay, and treats repeated rows alike.
Line dedup leaves null texts and blank lines alone and may leave an empty text; a null source is no
site. Near-duplicates keep one of repeated rows, all rows without doc_id, and each text of a repeated
doc_id by its own. Decontamination judges each row by its text alone. Packing takes a null text for an
empty one and packs rows without doc_id, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bagminhash, decontamination, lines, packing, toxicity
from graphloom.llm.store import remove, scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text that is left."""
    return lines.drop_spread_lines(docs, several_texts=True).withColumn("n_chars", F.char_length("text").cast("long"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_boilerplate),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL expresses neither the trained scorer nor the packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's checkpoints go once its table is written, and a table once the next one is; the last table stays for the result's readers."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs, made = written(stage(spark, docs, sf_dir))
        if path:
            remove(spark, path)
        path = made
    return STAGES[-1][1](spark, docs, sf_dir)
