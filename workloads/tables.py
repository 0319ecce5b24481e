"""The given tables, and the inputs of the library derived from them.

Each Spark derivation has a SQL twin, so that both sides of a check start from
the same rows. Every derivation covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.text import WHITESPACE, WHITESPACE_CODE_POINTS
from sievecraft.sources.corpus import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


# SQL spellings of the text rules
SQL_WS = "'" + WHITESPACE + "'"
SQL_WS_RUN = "'[" + "".join(f"\\x{{{p:X}}}" for p in WHITESPACE_CODE_POINTS) + "]+'"


def sql_words(text: str) -> str:
    return f"string_split_regex(trim(lower({text}), {SQL_WS}), {SQL_WS_RUN})"


# ---- reasoning rows --------------------------------------------------------


def by_doc(modulus: int, cases: dict[int, Column], otherwise: Column) -> Column:
    """Pick an expression by the residue of ``doc_id``."""
    chain = None
    for residue, value in cases.items():
        test = F.col("doc_id") % modulus == residue
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(otherwise)


def reasoning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with response, code, starter code and two nullable flags."""
    docs = documents(spark, sf_dir, "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    doc_id, text = F.col("doc_id"), F.col("text")
    null = F.lit(None).cast("string")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("q"), doc_id.cast("string")).alias("question_id"),
        (F.col("quality") == 1).alias("verified"),
        (F.col("toxic") == 0).alias("is_passed"),
        by_doc(5, {0: F.replace(text, F.lit(" "), F.lit("  "))}, text).alias("question"),
        by_doc(7, {0: null}, F.concat(text, F.repeat(F.lit("."), (doc_id % 5).cast("int")))).alias("response"),
        by_doc(
            4,
            {
                0: F.right(text, F.lit(80)),
                1: null,
                2: F.concat(F.lit("def f(x):\n    return x + "), doc_id.cast("string")),
            },
            F.lit(" \t　"),
        ).alias("code"),
        by_doc(3, {0: null, 1: F.lit(" \n")}, F.lit("def solve(x):\n    pass")).alias("starter_code"),
    )


SQL_REASONING = """
reasoning AS (
  SELECT d.doc_id,
         'q' || d.doc_id AS question_id,
         l.quality = 1 AS verified,
         l.toxic = 0 AS is_passed,
         CASE WHEN d.doc_id % 5 = 0 THEN replace(d.text, ' ', '  ') ELSE d.text END AS question,
         CASE WHEN d.doc_id % 7 = 0 THEN NULL
              ELSE d.text || repeat('.', CAST(d.doc_id % 5 AS INTEGER)) END AS response,
         CASE d.doc_id % 4
              WHEN 0 THEN right(d.text, 80)
              WHEN 1 THEN NULL
              WHEN 2 THEN 'def f(x):' || chr(10) || '    return x + ' || d.doc_id
              ELSE ' ' || chr(9) || chr(12288) END AS code,
         CASE d.doc_id % 3
              WHEN 0 THEN NULL
              WHEN 1 THEN ' ' || chr(10)
              ELSE 'def solve(x):' || chr(10) || '    pass' END AS starter_code
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def sql_fingerprint(words: str) -> str:
    """5-gram-set fingerprint of a column that holds a word list."""
    shifted = ", ".join([words] + [f"{words}[{k}:]" for k in range(2, 6)])
    return f"""
      CASE WHEN len({words}) < 5 THEN md5(array_to_string({words}, ' '))
           ELSE md5(array_to_string(list_sort(list_distinct(list_transform(
                  list_zip({shifted}, true),
                  lambda g: concat_ws(' ', g[1], g[2], g[3], g[4], g[5])))), chr(10)))
      END"""


def sql_unique_verified(max_tokens: int) -> str:
    return f"""{SQL_REASONING},
kept AS (
  SELECT doc_id, question_id, coalesce(question, '') AS question, coalesce(response, '') AS response,
         coalesce(code, '') AS code, coalesce(starter_code, '') AS starter_code
  FROM reasoning
  WHERE coalesce(verified, false) AND coalesce(is_passed, false)
    AND length(coalesce(response, '')) // 4 <= {max_tokens}
),
worded AS (SELECT *, {sql_words('question')} AS w FROM kept),
keyed AS (SELECT * EXCLUDE (w), {sql_fingerprint('w')} AS fingerprint FROM worded),
firsts AS (
  SELECT * FROM keyed
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) = 1
)"""


SQL_HAS_CODE = (
    f"contains(right(response, length(code) + 500), left(trim(code, {SQL_WS}), 50))"
)
SQL_CHAT_COLUMNS = f"""
  question_id AS id,
  question || CASE WHEN trim(starter_code, {SQL_WS}) <> ''
    THEN chr(10) || chr(10) || 'Starter code:' || chr(10) || '```python' || chr(10) || starter_code || chr(10) || '```'
    ELSE '' END AS user_content,
  response || CASE WHEN trim(code, {SQL_WS}) <> '' AND NOT {SQL_HAS_CODE}
    THEN chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```'
    ELSE '' END AS assistant_content,
  CAST(length(question) AS BIGINT) AS question_length,
  CAST(length(response) AS BIGINT) AS response_length,
  CAST(length(code) AS BIGINT) AS code_length,
  CAST(length(response) // 4 AS BIGINT) AS cot_tokens"""


# ---- instruction rows ------------------------------------------------------


def _judge_json(req: str, logic: str, edge: str) -> str:
    return (
        '{"requirement_conformance": {"score": ' + req + '}, "logical_correctness": {"score": '
        + logic + ', "justification": "ok"}, "edge_case_consideration": {"score": ' + edge + "}}"
    )


# (residue of doc_id % 17, judgement text)
JUDGEMENTS = {
    0: _judge_json("5", "5", "3"),
    1: _judge_json("4", "5", "5"),
    2: _judge_json('"5"', "5", "5"),
    3: _judge_json("5", "5", "5") + " junk",
    4: '{"requirement_conformance": {"score": 5}, "logical_correctness": {"score": 5}}',
    5: "not json",
    6: _judge_json("5.0", "5.5", "4.5"),
    7: _judge_json("5", "5", "4"),
    8: _judge_json("5", "5", '"Infinity"'),
    9: _judge_json("5", "5", "5") + '],"x":[0',
    10: _judge_json('"NaN"', "5", "5"),
    11: _judge_json("NaN", "5", "5"),
    12: _judge_json("5", "Infinity", "4.5"),
    13: _judge_json("-Infinity", "5", "5"),
    14: _judge_json("4", "5", "5") + '],"v":[' + _judge_json("5", "5", "5"),
}
JUDGEMENT_ELSE = _judge_json("5", "5", "5")
# (residue of doc_id % 10, status text)
STATUSES = {
    0: '["pass", "fail"]',
    1: "[]",
    2: "oops",
    3: '["pass", null]',
    4: "['pass']",
    5: '["pass"]],"x":[["a"',
}
STATUS_ELSE = '["pass", "pass"]'


def instruction_rows(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Instructions with judge scores and test results as JSON text."""
    if docs is None:
        docs = documents(spark, sf_dir, "text", "lang", "source")
    doc_id, text = F.col("doc_id"), F.col("text")
    return docs.select(
        "doc_id",
        doc_id.cast("string").alias("id"),
        by_doc(3, {0: F.concat(F.lit("\t　"), text), 1: F.concat(text, F.lit("\n "))}, text).alias("input"),
        F.concat(text, F.repeat(F.lit("."), (doc_id % 7).cast("int"))).alias("output"),
        F.col("lang").alias("domain"),
        F.col("source").alias("generation_algorithm"),
        by_doc(17, {k: F.lit(v) for k, v in JUDGEMENTS.items()}, F.lit(JUDGEMENT_ELSE)).alias("llm_judgement"),
        by_doc(10, {k: F.lit(v) for k, v in STATUSES.items()}, F.lit(STATUS_ELSE)).alias("tests_execution_status"),
    )


def _sql_cases(modulus: int, cases: dict[int, str], otherwise: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in cases.items())
    return f"CASE doc_id % {modulus} {whens} ELSE {quote(otherwise)} END"


SQL_INSTRUCTIONS = f"""
instructions AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id,
         CASE doc_id % 3 WHEN 0 THEN chr(9) || chr(12288) || text
                         WHEN 1 THEN text || chr(10) || ' ' ELSE text END AS input,
         text || repeat('.', CAST(doc_id % 7 AS INTEGER)) AS output,
         lang AS domain, source AS generation_algorithm,
         {_sql_cases(17, JUDGEMENTS, JUDGEMENT_ELSE)} AS j,
         {_sql_cases(10, STATUSES, STATUS_ELSE)} AS t
  FROM documents
),
typed AS (
  SELECT *,
    CASE WHEN json_valid(jn) THEN json(jn) END AS jj,
    CASE WHEN json_valid(t) THEN json(t) END AS tj
  FROM (SELECT *, regexp_replace(regexp_replace(j, ': (NaN|Infinity)', ': 9e99', 'g'), ': -Infinity', ': -9e99', 'g') AS jn FROM instructions)
),
scored AS (
  SELECT * EXCLUDE (jj, tj, jn),
    CASE WHEN json_type(jj, '$.requirement_conformance.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
         THEN CAST(jj->>'$.requirement_conformance.score' AS DOUBLE) ELSE 0 END AS s1,
    CASE WHEN json_type(jj, '$.logical_correctness.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
         THEN CAST(jj->>'$.logical_correctness.score' AS DOUBLE) ELSE 0 END AS s2,
    CASE WHEN json_type(jj, '$.edge_case_consideration.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
         THEN CAST(jj->>'$.edge_case_consideration.score' AS DOUBLE) ELSE 0 END AS s3,
    coalesce(json_type(tj) = 'ARRAY'
      AND len(list_filter(from_json(tj, '["VARCHAR"]'), lambda x: x IS DISTINCT FROM 'pass')) = 0, false) AS tests_ok
  FROM typed
),
judged AS (
  SELECT * EXCLUDE (s1, s2, s3, tests_ok),
         s1 >= 5 AND s2 >= 5 AND s3 >= 4 AND tests_ok AS passed,
         CASE WHEN s1 >= 5 AND s2 >= 5 AND s3 >= 4 AND tests_ok THEN s3 ELSE CAST(0 AS DOUBLE) END AS edge_score
  FROM scored
)"""

SQL_BEST = f"""{SQL_INSTRUCTIONS},
best AS (
  SELECT * FROM judged WHERE passed
  QUALIFY row_number() OVER (
    PARTITION BY md5(trim(input, {SQL_WS})) ORDER BY edge_score DESC, length(output), doc_id) = 1
)"""
