"""Queries over label sequences, row order and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.labels import IGNORE_INDEX, position_weights
from sievecraft.functions.text import words
from sievecraft.operators.labels import (
    decode_responses,
    response_tokens,
    suffix_sources,
    suffix_windows,
    weigh_positions,
    weighted_mean,
    with_pieces,
)
from sievecraft.sources.corpus import spread
from workloads.tables import sql_words, table

SAMPLE = ["conv_id", "turn"]
K = 48
STRIDE = 8
MIN_LEN = 16


def token_id(word):
    """60 bits of the MD5; ``vocabulary`` fails if two words should share them."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


def label_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One sample per turn: assistant words are labels, with prompt gaps inside."""
    turns = spread(table(spark, sf_dir, "conversations"), *SAMPLE)
    role = F.col("role")

    def label(w, i):
        prompt = (role != "assistant") | (F.floor(i / 16) % 4 == 3)
        return F.when(prompt, F.lit(IGNORE_INDEX)).otherwise(token_id(w))

    return turns.select(*SAMPLE, "role", *more, F.transform(words(F.col("text")), label).alias("labels"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token id -> piece; every 40th id plays a special token."""
    pieces = spread(table(spark, sf_dir, "conversations").select(*SAMPLE, "text"), *SAMPLE).select(F.explode(words(F.col("text"))).alias("piece"))
    same = F.min("piece") == F.max("piece")
    piece = F.when(same, F.min("piece")).otherwise(F.raise_error(F.lit("two words with one id")))
    by_id = pieces.groupBy(token_id(F.col("piece")).alias("token_id")).agg(piece.alias("piece"))
    return by_id.withColumn("is_special", F.col("token_id") % 40 == 0)


def piece_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pieces(label_rows(spark, sf_dir), vocabulary(spark, sf_dir), SAMPLE)


SQL_LABELS = f"""
worded AS (SELECT conv_id, turn, role, {sql_words('text')} AS w FROM conversations),
label_rows AS (
  SELECT conv_id, turn, role, list_transform(w, lambda x, i:
      CASE WHEN role <> 'assistant' OR ((i - 1) // 16) % 4 = 3 THEN {IGNORE_INDEX}
           ELSE CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) END) AS labels
  FROM worded
),
tok AS (
  SELECT conv_id, turn, unnest(labels) AS tid, generate_subscripts(labels, 1) - 1 AS pos FROM label_rows
),
resp AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rank,
         count(*) OVER (PARTITION BY conv_id, turn) AS n
  FROM tok WHERE tid <> {IGNORE_INDEX}
),
vocab AS (
  SELECT CAST('0x' || substr(md5(p), 1, 15) AS BIGINT) AS token_id, min(p) AS piece
  FROM (SELECT unnest(w) AS p FROM worded) GROUP BY 1
),
blank AS (SELECT token_id FROM vocab WHERE token_id % 40 = 0 OR piece = ''),
win AS (
  SELECT conv_id, turn, pos, tid,
         list(tid) FILTER (WHERE tid <> {IGNORE_INDEX}) OVER w AS suffix,
         count(*) FILTER (WHERE tid <> {IGNORE_INDEX}) OVER w AS n_suffix,
         count(*) FILTER (WHERE tid <> {IGNORE_INDEX} AND tid NOT IN (SELECT token_id FROM blank)) OVER w AS n_visible
  FROM tok
  WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {K} FOLLOWING)
)"""


def _sql_anchors(stride: int) -> str:
    return f"""
anchors AS (
  SELECT w.conv_id, w.turn, w.pos, w.suffix
  FROM win w JOIN resp r ON r.conv_id = w.conv_id AND r.turn = w.turn AND r.pos = w.pos
  WHERE (r.rank - 1) % {stride} = 0 AND w.n_suffix >= {MIN_LEN} AND w.n_visible > 0
)"""


def q_response_tokens(spark, sf_dir) -> DataFrame:
    rows = response_tokens(label_rows(spark, sf_dir), SAMPLE)
    return rows.select(*SAMPLE, F.col("pos").cast("long").alias("pos"), F.col("token_id").cast("long").alias("token_id"))


def q_decode_responses(spark, sf_dir) -> DataFrame:
    return decode_responses(label_rows(spark, sf_dir), vocabulary(spark, sf_dir), SAMPLE, sep=" ")


def _windows(spark, sf_dir, stride: int) -> DataFrame:
    rows = suffix_windows(piece_rows(spark, sf_dir), SAMPLE, K, stride, MIN_LEN)
    return rows.select(
        *SAMPLE, F.col("pos").cast("long").alias("pos"), F.array_join("suffix", " ").alias("suffix")
    )


def _sources(spark, sf_dir, stride: int) -> DataFrame:
    rows = suffix_sources(piece_rows(spark, sf_dir), SAMPLE, K, stride, MIN_LEN)
    return rows.select(
        *SAMPLE,
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.col("src_pos").cast("long"), F.lit(-1)).alias("src_pos"),
        "has_target",
    )


def q_suffix_windows(spark, sf_dir) -> DataFrame:
    return _windows(spark, sf_dir, STRIDE)


def q_suffix_windows_every(spark, sf_dir) -> DataFrame:
    return _windows(spark, sf_dir, 1)


def q_nearest_anchor(spark, sf_dir) -> DataFrame:
    return _sources(spark, sf_dir, STRIDE)


def q_own_targets(spark, sf_dir) -> DataFrame:
    return _sources(spark, sf_dir, 1)


def q_position_weights(spark, sf_dir) -> DataFrame:
    rows = weigh_positions(label_rows(spark, sf_dir), SAMPLE)
    return rows.select(
        *SAMPLE,
        F.col("pos").cast("long").alias("pos"),
        F.col("rank").cast("long").alias("rank"),
        F.round("weight", 9).alias("weight"),
    )


def q_weighted_mean_loss(spark, sf_dir) -> DataFrame:
    """Per conversation; the loss of a token is made up from its id."""
    rows = label_rows(spark, sf_dir).select(
        "conv_id",
        F.inline(
            F.transform(
                position_weights(F.col("labels")),
                lambda s: F.struct(
                    s["weight"].alias("weight"),
                    ((F.get(F.col("labels"), s["pos"]) % 1000) / 1000.0).alias("loss"),
                ),
            )
        ),
    )
    means = weighted_mean(rows, F.col("loss"), F.col("weight"), ["conv_id"])
    return means.select("conv_id", F.round("weighted_loss", 6).alias("weighted_loss"))


QUERIES = {
    "response_tokens": q_response_tokens,
    "decode_responses": q_decode_responses,
    "suffix_windows": q_suffix_windows,
    "suffix_windows_every": q_suffix_windows_every,
    "nearest_anchor": q_nearest_anchor,
    "own_targets": q_own_targets,
    "position_weights": q_position_weights,
    "weighted_mean_loss": q_weighted_mean_loss,
}


def _sql_windows(stride: int) -> str:
    return f"""WITH {SQL_LABELS}, {_sql_anchors(stride)}
        SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, array_to_string(suffix, ' ') AS suffix FROM anchors"""


ORACLE = {
    "response_tokens": f"""WITH {SQL_LABELS}
        SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, CAST(tid AS BIGINT) AS token_id FROM resp""",
    "decode_responses": f"""WITH {SQL_LABELS}
        SELECT l.conv_id, l.turn, coalesce(string_agg(v.piece, ' ' ORDER BY r.pos), '') AS text
        FROM label_rows l
        LEFT JOIN resp r ON r.conv_id = l.conv_id AND r.turn = l.turn
        LEFT JOIN (SELECT * FROM vocab WHERE token_id % 40 <> 0) v ON v.token_id = r.tid
        GROUP BY l.conv_id, l.turn""",
    "suffix_windows": _sql_windows(STRIDE),
    "suffix_windows_every": _sql_windows(1),
    "nearest_anchor": f"""WITH {SQL_LABELS}, {_sql_anchors(STRIDE)},
        ranked AS (
          SELECT r.conv_id, r.turn, r.pos, a.pos AS src_pos,
                 row_number() OVER (PARTITION BY r.conv_id, r.turn, r.pos
                                    ORDER BY abs(a.pos - r.pos), a.pos) AS nearness
          FROM resp r LEFT JOIN anchors a ON a.conv_id = r.conv_id AND a.turn = r.turn
        )
        SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, CAST(coalesce(src_pos, -1) AS BIGINT) AS src_pos,
               src_pos IS NOT NULL AS has_target FROM ranked WHERE nearness = 1""",
    "own_targets": f"""WITH {SQL_LABELS}, {_sql_anchors(1)}
        SELECT r.conv_id, r.turn, CAST(r.pos AS BIGINT) AS pos, CAST(coalesce(a.pos, -1) AS BIGINT) AS src_pos,
               a.pos IS NOT NULL AS has_target
        FROM resp r LEFT JOIN anchors a ON a.conv_id = r.conv_id AND a.turn = r.turn AND a.pos = r.pos""",
    "position_weights": f"""WITH {SQL_LABELS}
        SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, CAST(rank AS BIGINT) AS rank,
               round((n - rank + 1) / CAST(n AS DOUBLE), 9) AS weight FROM resp""",
    "weighted_mean_loss": f"""WITH {SQL_LABELS},
        w AS (SELECT conv_id, (n - rank + 1) / CAST(n AS DOUBLE) AS weight, (tid % 1000) / 1000.0::DOUBLE AS loss FROM resp)
        SELECT conv_id, round(sum(loss * weight) / greatest(sum(weight), 1.0), 6) AS weighted_loss
        FROM w GROUP BY conv_id""",
}
