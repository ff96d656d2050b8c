"""A corpus made ready for training, in five stages over the table documents.

Each stage gets what its predecessor kept, written as Parquet and read again, and all but the last return the columns of
documents. The last returns the packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsql.llm import compact_windows, dart_minhash, packing, quality_rules, toxicity
from plainsql.llm.text import shared_folder

#: SQL has no classifier, no min-hashes and no tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as a struct, so an operator can carry it along and its verdict needs no join."""
    return docs.select("doc_id", "text", F.struct("*").alias("whole"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and that column's name. A stage's input is a stored table, so numbers are the same
    however often it is read; they tell rows apart whose doc_id is null or repeated."""
    name = _free(docs, "row_number")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic."""
    return toxicity.toxicity(_whole(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), row="whole").where("predicted = 0").select("whole.*")


def fair_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality_rules.judged(_whole(docs), row="whole").where("kept").select("whole.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near duplicates, null being the largest; one row of equal ids."""
    rows, number = _numbered(docs)
    classes = dart_minhash.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"))
    named = classes.join(rows.select(F.col(number).alias("row"), F.col("doc_id").alias("id")), F.col("doc_id") == F.col("row"))
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("x")).select(F.col("x.row").alias(number))
    return rows.join(first, number, "left_semi").select(*docs.columns)


def fresh_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id has; a document of which nothing is left goes."""
    rows, number = _numbered(docs)
    kept, gone = _free(rows, "kept"), _free(rows, "n_removed")
    shorter = compact_windows.deduplicated(rows, with_text=True, key=number).where("n_removed > 0").select(number, F.col("kept").alias(kept), F.col("n_removed").alias(gone))
    left = rows.join(shorter, number, "left").where(F.col(kept).isNull() | (F.trim(kept) != ""))
    new = {"text": F.coalesce(kept, "text"), "n_chars": F.when(F.col(kept).isNotNull(), F.length(kept).cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens at most."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean_language), ("quality rules", fair_quality), ("near duplicates", one_of_each), ("substring dedup", fresh_passages), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table documents in sf_dir.

    Null and empty texts fail the quality rules. Rows whose doc_id is null or repeated are judged each by itself; a null is the
    largest id. Repeated rows are copies, of which one stays. Extra columns pass through the stages, whatever their names.
    Empty table: no rows. What a stage has written is removed when the next one has ended; the last result stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
