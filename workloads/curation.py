"""Queries over the filters, dedups, chat builders and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.text import ngram_fingerprint, normalize, strip, strip_key
from sievecraft.operators.dedup import dedup_report, keep_first
from sievecraft.operators.quality import (
    FUNNEL,
    file_report,
    filter_funnel,
    keep_verified,
    passing_instructions,
    score_instructions,
    with_reject_reason,
)
from sievecraft.operators.records import to_messages
from sievecraft.plans.instructions import curate_instructions
from sievecraft.plans.reasoning import curate_counted, curate_reasoning, profile_records
from sievecraft.session import shared_path
from sievecraft.sources.corpus import read_corpus, read_prompt
from workloads.tables import (
    SQL_BEST,
    SQL_CHAT_COLUMNS,
    SQL_INSTRUCTIONS,
    SQL_REASONING,
    SQL_WS,
    documents,
    instruction_rows,
    reasoning_rows,
    sql_fingerprint,
    sql_unique_verified,
    sql_words,
)

# Fixed value: the system prompt of the chat records.
SYSTEM_PROMPT = "You are an expert Python programmer. Solve the given coding task by providing a complete and correct Python solution enclosed in ```python``` code blocks."  # noqa: E501
SEQ = ["doc_id"]
SEQ_FILES, SHARDS = ["seq_file", "seq_row"], 4
TIGHT_BUDGET = 700  # tokens; low enough for the budget test to reject some rows


def flat_chat(records: DataFrame, *keep: str) -> DataFrame:
    """Chat records with one column per message and measure."""
    chat, meta = F.col("conversations"), F.col("metadata")
    lengths = ("question_length", "response_length", "code_length", "cot_tokens")
    return records.select(
        "id",
        chat[0]["content"].alias("user_content"),
        chat[1]["content"].alias("assistant_content"),
        *[meta[n].cast("long").alias(n) for n in lengths],
        *keep,
    )


def q_curate_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_chat(curate_reasoning(reasoning_rows(spark, sf_dir), SEQ))


def q_curate_reasoning_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_chat(curate_reasoning(reasoning_rows(spark, sf_dir), SEQ, TIGHT_BUDGET))


def q_curate_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_instructions(instruction_rows(spark, sf_dir), SEQ).drop("doc_id")


def q_instruction_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = curate_instructions(instruction_rows(spark, sf_dir), SEQ)
    m, path = F.col("messages"), shared_path(spark, "prompt")
    spark.range(1).select(F.lit(f"\n  {SYSTEM_PROMPT} \n").alias("value")).write.text(path)
    return to_messages(best, read_prompt(spark, path), "id").select(
        "id",
        m[0]["content"].alias("system_content"),
        m[1]["content"].alias("user_content"),
        m[2]["content"].alias("assistant_content"),
        F.concat_ws(",", m["role"]).alias("roles"),
    )


def q_judge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_instructions(instruction_rows(spark, sf_dir)).select("id", "passed", "edge_score")


def q_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_instructions(instruction_rows(spark, sf_dir))
    return file_report(scored, "generation_algorithm")


def q_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_reject_reason(reasoning_rows(spark, sf_dir), TIGHT_BUDGET)
    return rows.select("question_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


def q_corpus_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files: curated with the counters of the whole and of each file."""
    path = shared_path(spark, "corpus")
    shards = reasoning_rows(spark, sf_dir).withColumn("shard", F.col("doc_id") % SHARDS)
    shards.write.partitionBy("shard").parquet(path)  # every task adds a file to each shard: none holds a whole one
    corpus = read_corpus(spark, path, "part-*.parquet").withColumn("file_name", F.regexp_extract(SEQ_FILES[0], r"shard=(\d+)", 1))
    counted = curate_counted(corpus, SEQ_FILES, shared_path(spark, "curated"), max_tokens=TIGHT_BUDGET)
    records = counted.records.groupBy(F.regexp_extract(SEQ_FILES[0], r"shard=(\d+)", 1).alias("file_name")).agg(F.count("*").alias("records"))
    whole = {name: counted.funnel.select(name).scalar() for name in FUNNEL}
    return counted.files.join(records, "file_name", "left").withColumns(whole)


def q_filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_funnel(reasoning_rows(spark, sf_dir), TIGHT_BUDGET)


def q_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instruction_rows(spark, sf_dir)
    text = F.col("input")
    return rows.select(
        "id",
        F.length(strip(text)).cast("long").alias("stripped_length"),
        strip_key(text).alias("strip_key"),
        F.md5(normalize(text)).alias("normal_key"),
        ngram_fingerprint(text).alias("fingerprint"),
    )


def q_dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = curate_instructions(instruction_rows(spark, sf_dir), SEQ)
    return best.select("doc_id", F.length("output").cast("long").alias("output_length"))


def q_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text", "lang", "source", "n_chars")
    kept = keep_first(docs, ngram_fingerprint(F.col("text")), SEQ)
    return kept.select("doc_id", "lang", "source", "n_chars")


def q_dedup_report_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    passing = passing_instructions(instruction_rows(spark, sf_dir), *SEQ)
    return dedup_report(passing, strip_key(F.col("input")))


def q_dedup_report_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keep_verified(reasoning_rows(spark, sf_dir))
    return dedup_report(kept, ngram_fingerprint(F.col("question")))


def q_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_records(curate_reasoning(reasoning_rows(spark, sf_dir), SEQ))[0]


def q_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_records(curate_reasoning(reasoning_rows(spark, sf_dir), SEQ))[1]


QUERIES = {
    "curate_reasoning": q_curate_reasoning,
    "curate_reasoning_tight": q_curate_reasoning_tight,
    "curate_instructions": q_curate_instructions,
    "instruction_messages": q_instruction_messages,
    "judge_filter": q_judge_filter,
    "file_report": q_file_report,
    "reject_reasons": q_reject_reasons,
    "filter_funnel": q_filter_funnel,
    "corpus_of_files": q_corpus_of_files,
    "text_keys": q_text_keys,
    "dedup_keep_best": q_dedup_keep_best,
    "dedup_keep_first": q_dedup_keep_first,
    "dedup_report_exact": q_dedup_report_exact,
    "dedup_report_ngram": q_dedup_report_ngram,
    "length_profile": q_length_profile,
    "token_totals": q_token_totals,
}

_REASON = f"""
  CASE WHEN NOT coalesce(verified, false) THEN 'not_verified'
       WHEN NOT coalesce(is_passed, false) THEN 'not_passed'
       WHEN length(coalesce(response, '')) // 4 > {TIGHT_BUDGET} THEN 'cot_too_long'
       ELSE 'kept' END"""
_MEASURES = "WITH " + sql_unique_verified(16000) + """,
lens AS (
  SELECT length(question) AS q, length(response) AS r, length(code) AS c, length(response) // 4 AS t FROM firsts
)"""


def _sql_profile(measure: str, column: str) -> str:
    return f"""
SELECT '{measure}' AS measure, CAST(min({column}) AS BIGINT) AS min_value,
       CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC) AS BIGINT) AS p50_value,
       CAST(max({column}) AS BIGINT) AS max_value, count(*) AS entries
FROM lens HAVING count(*) > 0"""


ORACLE = {
    "curate_reasoning": f"WITH {sql_unique_verified(16000)} SELECT {SQL_CHAT_COLUMNS} FROM firsts",
    "curate_reasoning_tight": f"WITH {sql_unique_verified(TIGHT_BUDGET)} SELECT {SQL_CHAT_COLUMNS} FROM firsts",
    "curate_instructions": f"WITH {SQL_BEST} SELECT id, input, output, domain, generation_algorithm FROM best",
    "instruction_messages": f"""WITH {SQL_BEST}
        SELECT id, '{SYSTEM_PROMPT}' AS system_content, input AS user_content, output AS assistant_content,
               'system,user,assistant' AS roles FROM best""",
    "judge_filter": f"WITH {SQL_INSTRUCTIONS} SELECT id, passed, edge_score FROM judged",
    "file_report": f"""WITH {SQL_INSTRUCTIONS}
        SELECT generation_algorithm, count(*) FILTER (WHERE passed) AS kept, count(*) AS total,
               round(count(*) FILTER (WHERE passed) * 100.0::DOUBLE / count(*), 1) AS kept_percent
        FROM judged GROUP BY generation_algorithm""",
    "reject_reasons": f"WITH {SQL_REASONING} SELECT question_id, {_REASON} AS reason FROM reasoning",
    "filter_funnel": f"""WITH {SQL_REASONING}, r AS (SELECT {_REASON} AS reason FROM reasoning)
        SELECT count(*) AS total_rows,
               count(*) FILTER (WHERE reason = 'not_verified') AS not_verified,
               count(*) FILTER (WHERE reason = 'not_passed') AS not_passed,
               count(*) FILTER (WHERE reason = 'cot_too_long') AS cot_too_long,
               count(*) FILTER (WHERE reason = 'kept') AS passed_filter FROM r""",
    "corpus_of_files": f"""WITH {sql_unique_verified(TIGHT_BUDGET)},
        r AS (SELECT doc_id % {SHARDS} AS shard, {_REASON} AS reason FROM reasoning),
        funnel AS (
          SELECT count(*) AS total_rows,
               count(*) FILTER (WHERE reason = 'not_verified') AS not_verified,
               count(*) FILTER (WHERE reason = 'not_passed') AS not_passed,
               count(*) FILTER (WHERE reason = 'cot_too_long') AS cot_too_long,
               count(*) FILTER (WHERE reason = 'kept') AS passed_filter FROM r),
        files AS (SELECT shard, count(*) FILTER (WHERE reason = 'kept') AS kept, count(*) AS total FROM r GROUP BY shard),
        first_shard AS (SELECT min(doc_id % {SHARDS}) AS shard FROM keyed GROUP BY fingerprint),
        records AS (SELECT shard, count(*) AS records FROM first_shard GROUP BY shard)
        SELECT CAST(f.shard AS VARCHAR) AS file_name, kept, total, round(kept * 100.0::DOUBLE / total, 1) AS kept_percent,
          records, funnel.* FROM files f LEFT JOIN records USING (shard), funnel""",
    "text_keys": f"""WITH {SQL_INSTRUCTIONS},
        worded AS (SELECT id, input, {sql_words('input')} AS w FROM instructions)
        SELECT id, CAST(length(trim(input, {SQL_WS})) AS BIGINT) AS stripped_length,
               md5(trim(input, {SQL_WS})) AS strip_key,
               md5(array_to_string(w, ' ')) AS normal_key,
               {sql_fingerprint('w')} AS fingerprint FROM worded""",
    "dedup_keep_best": f"WITH {SQL_BEST} SELECT doc_id, CAST(length(output) AS BIGINT) AS output_length FROM best",
    "dedup_keep_first": f"""WITH worded AS (SELECT *, {sql_words('text')} AS w FROM documents),
        keyed AS (SELECT *, {sql_fingerprint('w')} AS fingerprint FROM worded)
        SELECT doc_id, lang, source, n_chars FROM keyed
        QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) = 1""",
    "dedup_report_exact": f"""WITH {SQL_INSTRUCTIONS},
        k AS (SELECT md5(trim(input, {SQL_WS})) AS k FROM judged WHERE passed)
        SELECT count(*) AS before, count(DISTINCT k) AS "unique", count(*) - count(DISTINCT k) AS removed FROM k""",
    "dedup_report_ngram": f"""WITH {sql_unique_verified(16000)}
        SELECT count(*) AS before, count(DISTINCT fingerprint) AS "unique",
               count(*) - count(DISTINCT fingerprint) AS removed FROM keyed""",
    "length_profile": _MEASURES
    + " UNION ALL ".join(
        _sql_profile(m, c)
        for m, c in (("question_length", "q"), ("response_length", "r"), ("code_length", "c"), ("cot_tokens", "t"))
    ),
    "token_totals": _MEASURES
    + """ SELECT count(*) AS entries, CAST(sum(q + r) // 4 AS BIGINT) AS total_tokens,
               CAST((sum(q + r) // 4) // count(*) AS BIGINT) AS mean_tokens FROM lens""",
}
