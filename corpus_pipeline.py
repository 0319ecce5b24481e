"""A training corpus from documents: the stages, one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.llm import bpe, dart_minhash, decontaminate, pseudonyms, toxicity
from sievecraft.llm.common import bounded_batches, free_name, stored, table

PSEUDONYM_KEY = "pseudonym key of the pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic stays below the threshold."""
    model = toxicity.train_on_tables(spark, docs, sf_dir)
    with bounded_batches(spark):
        return stored(docs.where(toxicity.toxicity(F.col("text"), model) < toxicity.THRESHOLD), "clean")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near-duplicates.

    One row of each class stays: of rows that share its id the one of the smallest text,
    then of the smallest lang, source and other columns, nulls first. Rows without an id
    stay if no row with an id is in their class, one for each text. Null and wordless
    texts are alone, so they stay, one of each id.
    """
    content, row_id, group, rank = free_name(docs, "content", "row_id", "group", "rank")
    with bounded_batches(spark):
        found = dart_minhash.near_duplicates(docs.select("doc_id", "text"))
    kept = found.where("doc_id = class_id OR doc_id IS NULL AND class_id IS NULL")
    id_text, no_content = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.unhex(F.lit(""))
    # rows without an id are told apart by their text, others by the class
    named = F.when(F.col("doc_id").isNull(), F.col("content")).otherwise(F.col("class_content"))
    kept = kept.select(id_text.alias(row_id), F.coalesce("content", no_content).alias(content), F.coalesce(named, no_content).alias(group)).distinct()
    keyed = docs.withColumn(row_id, id_text).withColumn(content, F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), no_content))
    order = ["text", "lang", "source", *[c for c in docs.columns if c not in ("doc_id", "text", "lang", "source")]]
    first = Window.partitionBy(row_id, group).orderBy(*order)
    chosen = keyed.join(kept, [row_id, content])
    return chosen.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages, or too little of them to count."""
    kept, flag = docs.columns, free_name(docs, "contaminated_")[0]
    scanned = decontaminate.find_contamination(docs.select(F.struct(*kept).alias(flag), "text"), table(spark, sf_dir, "benchmark"))
    return scanned.where(~F.col("contaminated")).select(f"{flag}.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and secrets replaced by pseudonyms."""
    row = free_name(docs, "row")[0]
    replaced = pseudonyms.pseudonymise(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias(row), "text"), PSEUDONYM_KEY)
    return replaced.select(f"{row}.*", "text").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of the text that they decode to."""
    path = bpe.tokenizer_path("word_bpe_49k.json")
    both = docs.select("doc_id", "lang", "source", bpe.round_trip("text", path).alias("both"))
    encoded = both.select(
        "doc_id",
        "lang",
        "source",
        F.size("both.ids").cast("long").alias("n_tokens"),
        F.col("both.ids").alias("ids"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"),
    )
    with bounded_batches(spark):
        return stored(encoded, "encoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]

# Kernel machines, MinHash, keyed permutations and BPE have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
