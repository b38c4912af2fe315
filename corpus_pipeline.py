"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixing by source, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last return the
columns of ``docs``, whatever they are; run() writes what a stage returns as Parquet and the next one reads that.

In every stage null and empty texts, null ids, repeated rows and further columns are allowed and an empty table gives
an empty one; each function says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import bpe, language, mixing, near_dup, substrings
from quire.sources.shared import materialise


def _apart(columns: list[str], name: str) -> str:
    """A name that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and those whose language the model rejects; ``lang`` stays
    as it was.  Repeated rows share their fate."""
    names = [_apart(docs.columns, x) for x in ("lid_pred", "lid_score", "lid_accepted")]
    found = language.identify(docs, language.fit(docs), pred=names[0], score=names[1], accepted=names[2])
    return found.where(names[2]).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group.  Of rows that repeat an id and its text, the first in the
    order of their other columns stays; null ids and null texts are no duplicates and stay."""
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    nth = _apart(docs.columns, "nth_row")
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    window = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*(others or ["doc_id"]))
    once = left.where("doc_id is not null").withColumn(nth, F.row_number().over(window)).where(F.col(nth) == 1)
    return once.select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte strings of earlier documents out of later ones; a text of which nothing is left goes.  Null texts
    come back empty; null ids count as the largest; ``n_chars`` follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substrings.remove_repeats(docs, 50, carry=others, as_text=True)
    cut = cut.where((F.col("kept") != "") | (F.size("spans") == 0))
    shown = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint"), "doc_id": F.col("doc_id")}
    return cut.select(*[(shown[c] if c in shown else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lists the documents in the order of the Pfair schedule, whose every prefix has the target weights.  All rows
    stay, repeated ones and those with null or empty texts too; a null source is a source of its own."""
    return mixing.in_order(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes the ids again: one row of digests for each row; null texts are empty."""
    return bpe.query(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: Not expressible in SQL: a trained model, sketches with alignment, byte-level BPE.  tests/llm holds brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else materialise(docs), sf_dir)
    return docs
