"""A corpus from raw documents to packed windows, one operator a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide.llm import langid, near, packing, substrings, tiling
from clicktide.llm.common import ship, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: no letter, or too little confidence.

    So null and empty texts go.  Repeated rows are judged alike, a null ``lang``
    teaches nothing, and without any labelled row all documents go; an empty table
    stays empty.
    """
    ship(spark)
    others = [c for c in docs.columns if c != "doc_id"]
    # under names of their own, so that no column clashes with the verdict's
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"keep{i}") for i, c in enumerate(others)))
    verdicts = langid.predict(plain, langid.fit(docs), *(f"keep{i}" for i in range(len(others)))).where("not rejected")
    return verdicts.select("doc_id", *(F.col(f"keep{i}").alias(c) for i, c in enumerate(others))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate class: five words, similarity 0.8.

    A repeated row stays once, one that differs in other columns only as well; documents
    without an id, without words or with a null text are linked with nothing and stay.
    The texts of an id that repeats are judged each by its own class.  An empty table
    stays empty.
    """
    ship(spark)
    kept = near.classes(docs).where("kept and doc_id is not null").select("doc_id", "text_key", "class")
    # an id may have several texts of one class
    one = kept.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    kept = kept.where("class is null").select("doc_id", "text_key").unionByName(one.select("first.*")).distinct()
    same = (docs["doc_id"] == kept["doc_id"]) & (near.text_key(docs) == kept["text_key"])
    first = docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that an earlier document has; a document of which nothing is left goes.

    A character that was cut in two goes with the cut; a null text is empty and
    stays; ``n_chars``, if there, counts anew.  Rows of one id do not cut each other,
    a null id comes after all others, and an empty table stays empty.
    """
    ship(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substrings.remove_repeats(docs, keep=tuple(others), as_text=True)
    cut = cut.where((F.size("spans") == 0) | (F.octet_length("kept") > 0))
    out = cut.select(
        "doc_id", F.col("kept").alias("text"), *(F.col(f"keep{i}").alias(c) for i, c in enumerate(others)),
    )
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a test item.

    Null and empty texts and documents without an id stay; every row of an id
    goes if one of its texts leaks; with an empty ``benchmark`` all stay.
    """
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids.

    A null or empty text is its end id alone; repeated rows are packed each; an
    empty table gives no rows.
    """
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_substrings),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

# Models, signatures and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
