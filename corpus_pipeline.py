"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

1. toxicity: documents that the classifier predicts as toxic go.
2. language: documents whose language model rejects them (no letters, or a
   cross-entropy beyond the calibrated limit of their best language) go.
3. near_duplicates: of each component of near copies the document with the
   smallest doc_id stays, and of rows that repeat its doc_id and text one. Rows
   that share a doc_id but not a text are documents of their own. Rows without a
   doc_id or without words stay.
4. repeated_passages: words that an earlier document's passage covers are taken
   out; a document that loses none keeps its text as it was, any other has its
   remaining words joined by one space, and ``n_chars`` follows the text.
5. packing: one row per piece of a packed sequence, with its ids.

The first four return the columns of ``documents``. Models of stages 1 and 2 are
fitted on the rows each stage reads (labels come from ``labels``), on bounded
samples that leave out the held-out remainders of the single queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm import langid, neardup_text, packing, substrings, toxicity
from tidegraph.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(langid.remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(langid.remainder("doc_id", 4) != 2))
    return langid.predict(docs, model, keep=COLUMNS).where("accepted").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup_text.near_duplicates(docs).where("kept is not null")
    status = written(found.groupBy("doc_id", "row").agg(F.max("kept").alias("kept")), "near-duplicates")
    rows = docs.where("doc_id is not null").select(*COLUMNS, F.hash(F.col("text").cast("string")).alias("row"))
    marked = rows.join(status, ["doc_id", "row"], "left")
    first = Window.partitionBy("doc_id", "row").orderBy("n_chars")
    stay = marked.withColumn("nth", F.row_number().over(first)).where("kept is null or kept and nth = 1")
    return stay.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(docs, keep=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: The models, the joins and the packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
