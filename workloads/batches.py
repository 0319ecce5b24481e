"""Queries over readers, writers, row order and batch reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.labels import IGNORE_INDEX
from sievecraft.functions.ordering import seeded_digest
from sievecraft.functions.text import words
from sievecraft.operators.ordering import (
    holdout_split,
    number_rows,
    sample_cap,
    sample_order,
    scan_order,
    sort_by_id,
)
from sievecraft.operators.quality import fill_texts
from sievecraft.operators.reshape import (
    assign_batches,
    flatten_assets,
    pad_batches,
    split_target_reference,
    unpivot_pairs,
)
from sievecraft.plans.instructions import curate_instructions, export_instructions
from sievecraft.plans.reasoning import curate_reasoning, export_reasoning
from sievecraft.session import shared_path
from sievecraft.sources.corpus import SEQ as SCAN
from sievecraft.sources.corpus import read_corpus, read_jsonl
from sievecraft.sources.sinks import json_array_text
from workloads.curation import SEQ, SYSTEM_PROMPT, flat_chat
from workloads.tables import (
    SQL_BEST,
    SQL_CHAT_COLUMNS,
    documents,
    instruction_rows,
    reasoning_rows,
    sql_unique_verified,
    sql_words,
    table,
)

SEED = 13
CAP = 300
BATCH = 16


# ---- readers and writers ---------------------------------------------------


def q_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are numbered through all parts of a table."""
    rows = read_corpus(spark, sf_dir, "documents*.parquet")
    scan = rows.select("file_name", *SCAN, "doc_id", F.length("text").cast("long").alias("text_length"))
    numbered = number_rows(scan, SCAN, "row", by=["file_name"])
    return numbered.select("file_name", F.col("row").alias("seq_row"), "doc_id", "text_length")


def q_optional_column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column the files lack is read as null and filled."""
    schema = "doc_id bigint, text string, starter_code string"
    rows = read_corpus(spark, sf_dir, "documents*.parquet", schema)
    filled = fill_texts(rows.withColumnRenamed("text", "question"))
    return filled.select("doc_id", F.md5("question").alias("question_key"), "starter_code")


def q_jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated instructions to JSON lines, read back, to chat records, read back."""
    out = shared_path(spark, "instructions")
    chats = export_instructions(instruction_rows(spark, sf_dir), SEQ, out, SYSTEM_PROMPT)
    m = F.col("messages")
    return chats.select(
        F.concat_ws(",", m["role"]).alias("roles"),
        m[1]["content"].alias("user_content"),
        m[2]["content"].alias("assistant_content"),
    )


def q_export_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON lines the whole reasoning job leaves behind."""
    out = shared_path(spark, "reasoning")
    records = export_reasoning(reasoning_rows(spark, sf_dir), SEQ, out)
    return flat_chat(read_jsonl(spark, f"{out}/jsonl", records.drop(*SEQ).schema, ("id", "conversations", "metadata")))


def q_json_array_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the exported array, each parsed back on its own."""
    records = curate_reasoning(reasoning_rows(spark, sf_dir), SEQ)
    pieces = json_array_text(records, ["id", *SEQ])
    schema = records.schema.simpleString()
    body = F.regexp_replace(F.regexp_replace("value", r"\A\[\n", ""), r"(,|\n\])\z", "")
    return flat_chat(pieces.select(F.from_json(body, schema).alias("r")).select("r.*"))


# ---- order -----------------------------------------------------------------


def q_sort_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sort_by_id(docs, "source", SEQ)


def q_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_order(curate_instructions(instruction_rows(spark, sf_dir), SEQ), SEQ).select("doc_id", "id", "domain")


def q_shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sample_order(docs, "doc_id", SEED).withColumn("shuffle_key", seeded_digest(F.col("doc_id"), SEED))


def q_sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_cap(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], CAP).select("conv_id", "turn", "role")


def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, SEED)


def q_number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return number_rows(labels, "doc_id").select("doc_id", "row_number")


# ---- batches ---------------------------------------------------------------


def token_rows(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Documents as token arrays: the id of a word is its length, odd words are prompt."""
    w = F.col("w")
    docs = documents(spark, sf_dir, "source", "text")
    docs = docs if only is None else docs.join(only, "doc_id", "left_semi")
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("w"))
    return rows.select(
        "doc_id",
        "source",
        F.transform(w, lambda x: F.length(x)).alias("input_ids"),
        F.transform(w, lambda x: F.lit(1)).alias("attention_mask"),
        F.transform(w, lambda x: F.when(F.length(x) % 2 == 1, F.lit(IGNORE_INDEX)).otherwise(F.length(x))).alias(
            "labels"
        ),
        F.when(F.col("doc_id") % 3 != 0, F.filter(w, lambda x: F.length(x) >= 11)).alias("images"),
        F.filter(w, lambda x: F.length(x) == 10).alias("videos"),
        F.lit(None).cast("array<string>").alias("audios"),
    )


def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th good with the i-th bad document of a source; only the longer side has some left over.

    Ids are paired first; only the texts of pairs are read into tokens.
    """
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)").select("doc_id", "quality")
    sources = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source")
    numbered = number_rows(sources.join(labels, "doc_id"), "doc_id", "i", by=["source", "quality"])
    ids = [
        numbered.where(F.col("quality") == q).select("source", "i", F.col("doc_id").alias(name))
        for q, name in ((1, "chosen_id"), (0, "rejected_id"))
    ]
    both = ids[0].join(ids[1], ["source", "i"]).select("chosen_id", "rejected_id")
    fields = ("input_ids", "attention_mask", "labels")

    def side(name: str, *extra: str) -> DataFrame:
        columns = [F.col("doc_id").alias(f"{name}_id"), *[F.col(f).alias(f"{name}_{f}") for f in fields]]
        return token_rows(spark, sf_dir, both.select(F.col(f"{name}_id").alias("doc_id"))).select(*columns, *extra)

    chosen = side("chosen", "images", "videos", "audios")
    return both.join(chosen, "chosen_id").join(side("rejected"), "rejected_id")


def joined(name: str):
    return F.array_join(name, ",")


def q_preference_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unpivot_pairs(paired_rows(spark, sf_dir), "chosen_id", "rejected_id").orderBy("side", "chosen_id")
    return rows.select(
        "chosen_id",
        "rejected_id",
        F.col("side").cast("long").alias("side"),
        F.md5(joined("input_ids")).alias("input_key"),
        F.md5(joined("labels")).alias("label_key"),
        F.size("attention_mask").cast("long").alias("length"),
        F.size("videos").cast("long").alias("n_videos"),
    )


def q_target_reference_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired_rows(spark, sf_dir)
    for f in ("input_ids", "attention_mask", "labels"):
        rows = rows.withColumnRenamed(f"chosen_{f}", f).withColumnRenamed(f"rejected_{f}", f"kl_{f}")
    tagged = rows.withColumn("kto_tags", F.col("chosen_id") % 2 == 0)
    split = split_target_reference(tagged, "chosen_id")
    return split.select(
        "chosen_id",
        "kto_tags",
        F.md5(joined("target.input_ids")).alias("target_key"),
        F.md5(joined("reference.input_ids")).alias("reference_key"),
        F.md5(joined("reference.labels")).alias("reference_label_key"),
        F.size("reference.videos").cast("long").alias("n_videos"),
    )


def q_asset_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(spark, sf_dir).select("doc_id", "images", "videos", "audios")
    flat = flatten_assets(assign_batches(rows, "doc_id", BATCH), "doc_id")
    return flat.select(
        F.col("batch").cast("long").alias("batch"),
        joined("images").alias("images"),
        joined("images_counts").alias("images_counts"),
        joined("videos").alias("videos"),
        joined("videos_counts").alias("videos_counts"),
        joined("audios_counts").alias("audios_counts"),
    )


def q_pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(spark, sf_dir).select("doc_id", "input_ids", "attention_mask", "labels")
    padded = pad_batches(assign_batches(rows, "doc_id", BATCH))
    return padded.select(
        "doc_id",
        F.col("batch").cast("long").alias("batch"),
        F.col("padded_length").cast("long").alias("padded_length"),
        F.md5(joined("input_ids")).alias("input_key"),
        F.md5(joined("attention_mask")).alias("mask_key"),
        F.md5(joined("labels")).alias("label_key"),
    )


QUERIES = {
    "corpus_scan": q_corpus_scan,
    "optional_column_scan": q_optional_column_scan,
    "jsonl_round_trip": q_jsonl_round_trip,
    "export_reasoning": q_export_reasoning,
    "json_array_export": q_json_array_export,
    "sort_by_id": q_sort_by_id,
    "scan_order": q_scan_order,
    "shuffled_order": q_shuffled_order,
    "sample_cap": q_sample_cap,
    "holdout_split": q_holdout_split,
    "number_rows": q_number_rows,
    "preference_unpivot": q_preference_unpivot,
    "target_reference_split": q_target_reference_split,
    "asset_flatten": q_asset_flatten,
    "pad_batches": q_pad_batches,
}

_SQL_TOKENS = f"""
worded AS (SELECT doc_id, source, {sql_words('text')} AS w FROM documents),
token_rows AS (
  SELECT doc_id, source,
    list_transform(w, lambda x: length(x)) AS input_ids,
    list_transform(w, lambda x: CASE WHEN length(x) % 2 = 1 THEN {IGNORE_INDEX} ELSE length(x) END) AS labels,
    CASE WHEN doc_id % 3 <> 0 THEN list_filter(w, lambda x: length(x) >= 11) ELSE CAST([] AS VARCHAR[]) END AS images,
    list_filter(w, lambda x: length(x) = 10) AS videos,
    (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch
  FROM worded
)"""
_SQL_PAIRS = f"""
{_SQL_TOKENS},
numbered AS (
  SELECT d.source, l.quality, d.doc_id, row_number() OVER (PARTITION BY d.source, l.quality ORDER BY d.doc_id) AS i
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
),
ids AS (
  SELECT g.doc_id AS chosen_id, b.doc_id AS rejected_id
  FROM numbered g JOIN numbered b ON g.source = b.source AND g.i = b.i AND g.quality = 1 AND b.quality = 0
),
pairs AS (
  SELECT i.chosen_id, i.rejected_id, c.input_ids AS c_ids, c.labels AS c_labels, c.videos,
         r.input_ids AS r_ids, r.labels AS r_labels
  FROM ids i JOIN token_rows c ON c.doc_id = i.chosen_id JOIN token_rows r ON r.doc_id = i.rejected_id
)"""


def _sql_pair_side(side: int, prefix: str) -> str:
    return f"""
SELECT chosen_id, rejected_id, CAST({side} AS BIGINT) AS side, md5(array_to_string({prefix}_ids, ',')) AS input_key,
       md5(array_to_string({prefix}_labels, ',')) AS label_key, CAST(len({prefix}_ids) AS BIGINT) AS length,
       CAST(len(videos) AS BIGINT) AS n_videos FROM pairs"""


def _sql_padded(values: str, pad: str) -> str:
    return f"md5(array_to_string(list_concat({values}, list_transform(range(padded_length - len({values})), lambda i: {pad})), ','))"


ORACLE = {
    "corpus_scan": """SELECT 'documents.parquet' AS file_name, row_number() OVER (ORDER BY doc_id) - 1 AS seq_row, doc_id,
        CAST(length(text) AS BIGINT) AS text_length FROM documents""",
    "optional_column_scan": "SELECT doc_id, md5(text) AS question_key, '' AS starter_code FROM documents",
    "jsonl_round_trip": f"""WITH {SQL_BEST}
        SELECT 'system,user,assistant' AS roles, input AS user_content, output AS assistant_content FROM best""",
    "export_reasoning": f"WITH {sql_unique_verified(16000)} SELECT {SQL_CHAT_COLUMNS} FROM firsts",
    "json_array_export": f"WITH {sql_unique_verified(16000)} SELECT {SQL_CHAT_COLUMNS} FROM firsts",
    "sort_by_id": "SELECT source, doc_id, n_chars FROM documents ORDER BY source, doc_id",
    "scan_order": f"WITH {SQL_BEST} SELECT doc_id, id, domain FROM best ORDER BY doc_id",
    "shuffled_order": f"""SELECT doc_id, lang, md5('{SEED}:' || doc_id) AS shuffle_key FROM documents ORDER BY 3, 1""",
    "sample_cap": f"SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT {CAP}",
    "holdout_split": f"""SELECT doc_id, CASE WHEN
          (CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE < 0.1
          THEN 'validation' ELSE 'train' END AS split FROM documents""",
    "number_rows": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_number FROM labels",
    "preference_unpivot": f"WITH {_SQL_PAIRS} {_sql_pair_side(0, 'c')} UNION ALL {_sql_pair_side(1, 'r')}",
    "target_reference_split": f"""WITH {_SQL_PAIRS}
        SELECT chosen_id, chosen_id % 2 = 0 AS kto_tags, md5(array_to_string(c_ids, ',')) AS target_key,
               md5(array_to_string(r_ids, ',')) AS reference_key,
               md5(array_to_string(r_labels, ',')) AS reference_label_key,
               CAST(len(videos) AS BIGINT) AS n_videos FROM pairs""",
    "asset_flatten": f"""WITH {_SQL_TOKENS}
        SELECT batch,
               array_to_string(flatten(list(images ORDER BY doc_id)), ',') AS images,
               string_agg(CAST(len(images) AS VARCHAR), ',' ORDER BY doc_id) AS images_counts,
               array_to_string(flatten(list(videos ORDER BY doc_id)), ',') AS videos,
               string_agg(CAST(len(videos) AS VARCHAR), ',' ORDER BY doc_id) AS videos_counts,
               string_agg('0', ',' ORDER BY doc_id) AS audios_counts
        FROM token_rows GROUP BY batch""",
    "pad_batches": f"""WITH {_SQL_TOKENS},
        sized AS (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch) / 8.0) * 8 AS BIGINT) AS padded_length
                  FROM token_rows)
        SELECT doc_id, batch, padded_length, {_sql_padded('input_ids', '0')} AS input_key,
               {_sql_padded('list_transform(input_ids, lambda x: 1)', '0')} AS mask_key,
               {_sql_padded('labels', str(IGNORE_INDEX))} AS label_key FROM sized""",
}
