"""A corpus pipeline: language ID, line dedup, near-duplicate documents, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs.

What every stage does with odd rows: columns beyond those of documents are dropped by the first stage that meets them, whatever
their names; texts of any length are read whole; rows that repeat a doc_id, or have none, are rows of their own; an empty table
gives an empty one. Null texts have no letter, no line, no shingle and no word: language ID rejects them; the later stages,
given one, keep it (line dedup, near duplicates), take it 0 times (mix), or encode it as the empty text. Empty texts likewise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, shared_dir
from skein.llm.entropy_mix import mix_sources
from skein.llm.jaccard_join import near_copies, text_key
from skein.llm.language_id import UNDETERMINED, held_out_rows, predict_languages, train_network
from skein.llm.line_edit_join import dedup_lines
from skein.llm.sentencepiece_codec import encode_texts, model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has less is rejected.
LEAST_SCORE = 0.4
#: Keys of removed documents that may be broadcast.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a clear language."""
    net = train_network(docs.filter(~held_out_rows() & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang"))
    judged = predict_languages(docs.select(*COLUMNS), net)
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line equals (of any length, if not blank) or is near to, and documents that had such lines and keep none of their own."""
    out = dedup_lines(docs.select(*COLUMNS), equal_chars=1)
    own = F.exists(F.split("kept_text", "\n"), lambda x: x.rlike(r"\S"))
    out = out.filter((F.col("n_equal") + F.col("n_near") == 0) | own)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id (nulls last), then text hash, also where rows share an id."""
    copies = cut(near_copies(docs.select("doc_id", "text")))
    few = copies.count() <= BROADCAST_IDS
    t1, t2 = text_key(F.col("text"))
    rows = docs.select(*COLUMNS, t1.alias("__t1"), t2.alias("__t2"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2"))
    whole = rows.join(F.broadcast(copies) if few else copies, same, "left_anti").select(*COLUMNS)
    repeated = copies.filter("first")
    repeated = rows.join(F.broadcast(repeated) if few else repeated, same, "left_semi")
    one = repeated.groupBy("doc_id", "__t1", "__t2").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return whole.unionByName(one.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix of sources takes it, whatever its doc_id (null too); the others go."""
    taken = mix_sources(docs, carry=COLUMNS).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256."""
    out = encode_texts(docs, model_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("ids"), 256).alias("ids_sha256"))


STAGES = [("language_id", identify_language), ("line_dedup", remove_lines), ("near_duplicates", remove_near_duplicates), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{where}/{k}-{name}")
            docs = spark.read.parquet(f"{where}/{k}-{name}")
    return docs
