"""Queries over text vectors, pooling and alignment."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.labels import response_positions
from sievecraft.functions.vectors import cosine_distance, mean_squared_difference
from sievecraft.operators.alignment import metric_loss
from sievecraft.operators.cka import linear_cka
from sievecraft.operators.embed import (
    attach_embeddings,
    content_key,
    embed_incremental,
    embed_samples,
    encode_new,
    encode_texts,
    interpolation_pairs,
    mean_over_positions,
    mean_pool,
    sample_vector_positions,
    table_encode,
)
from sievecraft.operators.labels import response_tokens, suffix_loads, suffix_windows
from sievecraft.operators.skew import join_unique
from sievecraft.plans.targets import sample_targets, suffix_targets
from sievecraft.session import shared_path
from sievecraft.sources.corpus import spread
from workloads.tables import sql_words, table
from workloads.targets import (
    K,
    MIN_LEN,
    SAMPLE,
    SQL_LABELS,
    STRIDE,
    _sql_anchors,
    label_rows,
    piece_rows,
    vocabulary,
)

DIM = 64
HASH_DIM = 16
HASH_NAME = "hash16"


def make_hash_encoder():
    """A stand-in for a model: mean over words of the bytes of their md5, scaled to [-1, 1]."""

    def make():
        import hashlib

        import numpy as np

        def encode(texts, max_len):
            vectors = []
            for text in texts:
                digests = b"".join(hashlib.md5(w.encode()).digest() for w in text.lower().split()[:max_len])
                vectors.append((np.frombuffer(digests, "uint8").reshape(-1, 16) / 127.5 - 1).mean(axis=0))
            return vectors

        return encode

    return make


def as_ints(v: Column) -> Column:
    """A vector as text, in millionths."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 1e6).cast("long")), " ")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations").select(*SAMPLE, "role", "text"), *SAMPLE)


def q_embed_texts(spark, sf_dir) -> DataFrame:
    vector = encode_texts(F.col("text"), make_hash_encoder(), HASH_DIM, max_len=None, token_budget=2048)
    return turns(spark, sf_dir).select(*SAMPLE, as_ints(vector).alias("vector"))


def q_embed_incremental(spark, sf_dir) -> DataFrame:
    """Assistant turns first, then every turn on top of the stored vectors."""
    path = shared_path(spark, "vectors")
    rows = turns(spark, sf_dir)
    args = ("text", make_hash_encoder(), HASH_NAME, HASH_DIM, path, None)
    embed_incremental(rows.where("role = 'assistant'"), *args)
    stored = embed_incremental(rows, *args)
    return stored.select("content_key", as_ints(F.col("embedding")).alias("vector"))


def q_attach_embeddings(spark, sf_dir) -> DataFrame:
    rows = turns(spark, sf_dir)
    vectors = encode_new(rows, "text", make_hash_encoder(), HASH_NAME, HASH_DIM, max_len=None)
    attached = attach_embeddings(rows, vectors, "text", HASH_NAME, SAMPLE, max_len=None)
    return attached.select(*SAMPLE, "content_key", as_ints(F.col("embedding")).alias("vector"))


def _token_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _with_vec_id(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    n = vectors.agg(F.count(F.lit(1))).scalar()
    return tokens.withColumn("vec_id", F.col("token_id") % n)


def q_table_encode(spark, sf_dir) -> DataFrame:
    """Every sample's response, pooled from the vector table; zero without response."""
    vectors, rows = _token_vectors(spark, sf_dir), label_rows(spark, sf_dir)
    tokens = _with_vec_id(response_tokens(rows, SAMPLE), vectors)
    encoded = table_encode(tokens, vectors, SAMPLE, "vec_id")
    full = embed_samples(rows.select(*SAMPLE), encoded, SAMPLE, DIM)
    return full.select(*SAMPLE, as_ints(F.col("embedding")).alias("vector"))


def q_mean_over_positions(spark, sf_dir) -> DataFrame:
    """Suffix vectors of the anchors, summed over the positions they serve."""
    vectors, rows = _token_vectors(spark, sf_dir), label_rows(spark, sf_dir)
    pieced = piece_rows(spark, sf_dir)
    windows = suffix_windows(pieced, SAMPLE, K, STRIDE, MIN_LEN)
    tokens = windows.select(*SAMPLE, "pos", F.explode("suffix").alias("token_id"))
    anchors = table_encode(_with_vec_id(tokens, vectors), vectors, [*SAMPLE, "pos"], "vec_id")
    lengths = rows.select(*SAMPLE, F.size("labels").alias("length"))
    pooled = mean_over_positions(suffix_loads(pieced, SAMPLE, K, STRIDE, MIN_LEN), lengths, anchors, SAMPLE, DIM)
    return pooled.select(*SAMPLE, as_ints(F.col("pooled")).alias("vector"))


def q_sample_targets(spark, sf_dir) -> DataFrame:
    """Whole responses: decoded, encoded through a stored table, attached."""
    rows = sample_targets(
        label_rows(spark, sf_dir), vocabulary(spark, sf_dir), SAMPLE, make_hash_encoder(), HASH_NAME, HASH_DIM,
        shared_path(spark, "samples"), max_len=None, sep=" ",
    )
    return rows.select(*SAMPLE, "content_key", as_ints(F.col("embedding")).alias("vector"))


def q_suffix_targets(spark, sf_dir) -> DataFrame:
    """Anchor suffixes: decoded, encoded, and how many positions each serves."""
    anchors, _, loads = suffix_targets(
        label_rows(spark, sf_dir), vocabulary(spark, sf_dir), SAMPLE, make_hash_encoder(), HASH_NAME, HASH_DIM,
        shared_path(spark, "suffixes"), K, STRIDE, MIN_LEN, max_len=None, sep=" ",
    )
    served = loads.where("n > 0").select(*SAMPLE, F.col("src_pos").alias("pos"), F.col("n").alias("served"))
    return anchors.join(served, [*SAMPLE, "pos"]).select(
        *SAMPLE, F.col("pos").cast("long").alias("pos"), "served", as_ints(F.col("embedding")).alias("vector")
    )


def q_sample_vector_positions(spark, sf_dir) -> DataFrame:
    samples = label_rows(spark, sf_dir, "text").withColumn("content_key", content_key(F.col("text"), HASH_NAME, None))
    rows = sample_vector_positions(samples, response_positions(F.col("labels")), SAMPLE)
    return rows.select(*SAMPLE, F.col("pos").cast("long").alias("pos"), "content_key")


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def q_mean_pool(spark, sf_dir) -> DataFrame:
    pooled = mean_pool(_embeddings(spark, sf_dir), ["label"], "embedding")
    return pooled.select(F.col("label").cast("long").alias("label"), as_ints(F.col("pooled")).alias("vector"))


def q_vector_distances(spark, sf_dir) -> DataFrame:
    """Each vector against the mean of its label."""
    rows = _embeddings(spark, sf_dir)
    joined = join_unique(rows, mean_pool(rows, ["label"], "embedding"), "label", ["vec_id"])
    v, m = F.col("embedding"), F.col("pooled")
    return joined.select(
        "vec_id",
        F.round(cosine_distance(v, m), 8).alias("cosine_distance"),
        F.round(mean_squared_difference(v, m), 8).alias("mean_squared"),
    )


def q_interpolation_pairs(spark, sf_dir) -> DataFrame:
    """Each label is a sample, each vector a position in it."""
    rows = _embeddings(spark, sf_dir)
    pairs = interpolation_pairs(rows, "embedding", F.col("label"), F.col("vec_id"), DIM, seed=7)
    return pairs.select(
        "vec_id",
        F.round("t", 9).alias("t"),
        as_ints(F.col("z_t")).alias("z_t"),
        as_ints(F.col("v")).alias("v"),
    )


def _cka(spark, sf_dir, by: Column | None) -> DataFrame:
    v = F.col("embedding")
    return linear_cka(_embeddings(spark, sf_dir), F.slice(v, 1, 40), F.slice(v, 41, 24), ["vec_id"], by)


def q_linear_cka(spark, sf_dir) -> DataFrame:
    rows = _cka(spark, sf_dir, None)
    return rows.select("group", "n", F.round("cka", 8).alias("cka"), F.round("distance", 8).alias("distance"))


def q_linear_cka_by_label(spark, sf_dir) -> DataFrame:
    rows = _cka(spark, sf_dir, F.col("label"))
    return rows.select("group", "n", F.round("cka", 8).alias("cka"), F.round("distance", 8).alias("distance"))


def q_metric_by_name(spark, sf_dir) -> DataFrame:
    """All four metrics by label; the last vectors of a response weigh most, as positions do."""
    rows = interpolation_pairs(_embeddings(spark, sf_dir), "embedding", F.col("label"), F.col("vec_id"), DIM, seed=7)
    v, weight, by = F.col("embedding"), (F.col("vec_id") % 5) / 4, F.col("label")
    halves, parts = (F.slice(v, 1, 32), F.slice(v, 33, 32)), (F.slice(v, 1, 40), F.slice(v, 41, 24))
    compared = {"flow_matching": (F.col("z_t"), F.col("v")), "cosine": halves, "mse": halves, "cka": parts}
    losses = [
        metric_loss(rows, name, *sides, ["vec_id"], by, weight).select(F.lit(name).alias("metric"), "group", "n", F.round("loss", 6).alias("loss"))
        for name, sides in compared.items()
    ]
    return functools.reduce(DataFrame.unionByName, losses)


QUERIES = {
    "metric_by_name": q_metric_by_name,
    "embed_texts": q_embed_texts,
    "embed_incremental": q_embed_incremental,
    "attach_embeddings": q_attach_embeddings,
    "table_encode": q_table_encode,
    "mean_over_positions": q_mean_over_positions,
    "sample_targets": q_sample_targets,
    "suffix_targets": q_suffix_targets,
    "sample_vector_positions": q_sample_vector_positions,
    "mean_pool": q_mean_pool,
    "vector_distances": q_vector_distances,
    "interpolation_pairs": q_interpolation_pairs,
    "linear_cka": q_linear_cka,
    "linear_cka_by_label": q_linear_cka_by_label,
}


def _sql_ints(value: str, order: str) -> str:
    return f"string_agg(CAST(CAST(round(({value}) * 1e6) AS BIGINT) AS VARCHAR), ' ' ORDER BY {order})"


# (keys, text, j, x): unit mean of the word digests
def _sql_hash(source: str, keys: str) -> str:
    return f"""
hw AS (SELECT {keys}, text, md5(unnest({sql_words('text')})) AS h FROM {source}),
hd AS (
  SELECT {keys}, text, j, avg(CAST('0x' || substr(h, CAST(2 * j + 1 AS INTEGER), 2) AS INTEGER) / 127.5::DOUBLE - 1) AS m
  FROM hw, range({HASH_DIM}) AS r(j) GROUP BY ALL
),
unit AS (
  SELECT {keys}, text, j, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY {keys})), 1e-12) AS x
  FROM hd
)"""


_SQL_HASH = _sql_hash("conversations", "conv_id, turn")
_SQL_KEY = f"md5('{HASH_NAME}|None|' || text)"

# token vectors pooled per (conv_id, turn, pos): ``toks`` gives (conv_id, turn, pos, tid)
_SQL_POOL = """
n_vec AS (SELECT count(*) AS n FROM embeddings),
flat AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings),
pooled AS (
  SELECT t.conv_id, t.turn, t.pos, f.j, avg(f.x) AS m
  FROM toks t, n_vec JOIN flat f ON f.vec_id = t.tid % n_vec.n
  GROUP BY ALL
),
unit AS (
  SELECT conv_id, turn, pos, j, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY conv_id, turn, pos)), 1e-12) AS x
  FROM pooled
)"""
_ZERO = " ".join(["0"] * DIM)

_SQL_UNIT = "(CAST('0x' || {} AS BIGINT) + 0.5) / 4294967296.0::DOUBLE"
_SQL_T = _SQL_UNIT.format("substr(md5('7:t:' || label), 1, 8)")


def _sql_cka(group: str) -> str:
    """Gram-matrix form over all pairs of rows: the defining formula."""
    return f"""
WITH flat AS (
  SELECT vec_id, {group} AS g, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS j FROM embeddings
),
centred AS (SELECT vec_id, g, j, v - avg(v) OVER (PARTITION BY g, j) AS v FROM flat),
vecs AS (
  SELECT vec_id, g, list(v ORDER BY j) FILTER (WHERE j <= 40) AS x,
         list(v ORDER BY j) FILTER (WHERE j BETWEEN 41 AND 64) AS y
  FROM centred GROUP BY vec_id, g
),
gram AS (
  SELECT a.g, a.vec_id AS i, list_dot_product(a.x, b.x) AS k, list_dot_product(a.y, b.y) AS l
  FROM vecs a JOIN vecs b ON a.g = b.g AND a.vec_id <> b.vec_id
),
sums AS (SELECT g, i, sum(k) AS k, sum(l) AS l, sum(k * l) AS kl, sum(k * k) AS kk, sum(l * l) AS ll FROM gram GROUP BY g, i),
sizes AS (SELECT g, count(*) AS n FROM vecs GROUP BY g),
tot AS (
  SELECT z.g, z.n, sum(kl) AS kl, sum(kk) AS kk, sum(ll) AS ll, sum(k) AS sk, sum(l) AS sl,
         sum(k * l) AS skl, sum(k * k) AS skk, sum(l * l) AS sll
  FROM sizes z LEFT JOIN sums s ON s.g = z.g GROUP BY z.g, z.n
),
h AS (
  SELECT g, n,
    (kl + sk * sl / ((n - 1) * (n - 2)) - 2 * skl / (n - 2)) / (n * (n - 3)) AS hxy,
    (kk + sk * sk / ((n - 1) * (n - 2)) - 2 * skk / (n - 2)) / (n * (n - 3)) AS hxx,
    (ll + sl * sl / ((n - 1) * (n - 2)) - 2 * sll / (n - 2)) / (n * (n - 3)) AS hyy
  FROM tot
),
c AS (
  SELECT g, n, CASE WHEN n >= 4 THEN
    least(greatest(hxy / (sqrt(greatest(hxx * hyy, 1e-8)) + 1e-8), 0.0), 1.0) END AS cka FROM h
)
SELECT g AS "group", n, round(cka, 8) AS cka, round(1 - cka, 8) AS distance FROM c"""


_SQL_Z0 = f"""sqrt(-2 * ln({_SQL_UNIT.format('substr(h, 1, 8)')})) * cos(2 * pi() * {_SQL_UNIT.format('substr(h, 9, 8)')})"""

ORACLE = {
    "metric_by_name": f"""WITH flat AS (
          SELECT vec_id, label, unnest(embedding)::DOUBLE AS z1, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
        d AS (SELECT *, md5('7:z:' || vec_id || '#' || j) AS h, {_SQL_T} AS t FROM flat),
        n AS (SELECT *, {_SQL_Z0} AS z0 FROM d),
        flow AS (SELECT vec_id, label, avg(power((t * z1 + (1 - t) * z0) - (z1 - z0), 2)) AS loss FROM n GROUP BY vec_id, label),
        pairs AS (SELECT a.vec_id, a.label, a.z1 AS x, b.z1 AS y FROM flat a JOIN flat b ON a.vec_id = b.vec_id AND b.j = a.j + 32),
        halves AS (
          SELECT vec_id, label, avg(power(x - y, 2)) AS mse,
            1 - sum(x * y) / (greatest(sqrt(sum(x * x)), 1e-8) * greatest(sqrt(sum(y * y)), 1e-8)) AS cosine
          FROM pairs GROUP BY vec_id, label),
        losses AS (
          SELECT 'flow_matching' AS metric, vec_id, label, loss FROM flow
          UNION ALL SELECT 'mse', vec_id, label, mse FROM halves UNION ALL SELECT 'cosine', vec_id, label, cosine FROM halves)
        SELECT metric, CAST(label AS VARCHAR) AS "group", count(*) AS n,
          round(sum(loss * (vec_id % 5) / 4) / greatest(sum((vec_id % 5) / 4), 1.0), 6) AS loss
        FROM losses GROUP BY metric, label
        UNION ALL SELECT 'cka', "group", n, round(distance, 6) FROM ({_sql_cka("CAST(label AS VARCHAR)")})""",
    "embed_texts": f"""WITH {_SQL_HASH}
        SELECT conv_id, turn, {_sql_ints('x', 'j')} AS vector FROM unit GROUP BY conv_id, turn""",
    "embed_incremental": f"""WITH {_SQL_HASH}
        SELECT DISTINCT content_key, vector FROM (
          SELECT {_SQL_KEY} AS content_key, {_sql_ints('x', 'j')} AS vector FROM unit GROUP BY conv_id, turn, text)""",
    "attach_embeddings": f"""WITH {_SQL_HASH}
        SELECT conv_id, turn, {_SQL_KEY} AS content_key, {_sql_ints('x', 'j')} AS vector
        FROM unit GROUP BY conv_id, turn, text""",
    "table_encode": f"""WITH {SQL_LABELS}, toks AS (SELECT conv_id, turn, 0 AS pos, tid FROM resp), {_SQL_POOL},
        vec AS (SELECT conv_id, turn, {_sql_ints('x', 'j')} AS vector FROM unit GROUP BY conv_id, turn)
        SELECT l.conv_id, l.turn, coalesce(v.vector, '{_ZERO}') AS vector
        FROM label_rows l LEFT JOIN vec v ON v.conv_id = l.conv_id AND v.turn = l.turn""",
    "mean_over_positions": f"""WITH {SQL_LABELS}, {_sql_anchors(STRIDE)},
        toks AS (SELECT conv_id, turn, pos, unnest(suffix) AS tid FROM anchors), {_SQL_POOL},
        ranked AS (
          SELECT r.conv_id, r.turn, a.pos AS src_pos,
                 row_number() OVER (PARTITION BY r.conv_id, r.turn, r.pos ORDER BY abs(a.pos - r.pos), a.pos) AS near
          FROM resp r JOIN anchors a ON a.conv_id = r.conv_id AND a.turn = r.turn
        ),
        summed AS (
          SELECT r.conv_id, r.turn, u.j, sum(u.x) AS x
          FROM ranked r JOIN unit u ON u.conv_id = r.conv_id AND u.turn = r.turn AND u.pos = r.src_pos
          WHERE near = 1 GROUP BY ALL
        ),
        vec AS (
          SELECT s.conv_id, s.turn, {_sql_ints('s.x / len(l.labels)', 's.j')} AS vector
          FROM summed s JOIN label_rows l ON l.conv_id = s.conv_id AND l.turn = s.turn GROUP BY s.conv_id, s.turn
        )
        SELECT l.conv_id, l.turn, coalesce(v.vector, '{_ZERO}') AS vector
        FROM label_rows l LEFT JOIN vec v ON v.conv_id = l.conv_id AND v.turn = l.turn""",
    "sample_targets": f"""WITH {SQL_LABELS},
        decoded AS (
          SELECT l.conv_id, l.turn, coalesce(string_agg(v.piece, ' ' ORDER BY r.pos), '') AS text
          FROM label_rows l
          LEFT JOIN resp r ON r.conv_id = l.conv_id AND r.turn = l.turn
          LEFT JOIN (SELECT * FROM vocab WHERE token_id % 40 <> 0) v ON v.token_id = r.tid
          GROUP BY l.conv_id, l.turn),
        {_sql_hash("(SELECT * FROM decoded WHERE text <> '')", "conv_id, turn")},
        vec AS (SELECT conv_id, turn, {_sql_ints('x', 'j')} AS vector FROM unit GROUP BY conv_id, turn)
        SELECT d.conv_id, d.turn, {_SQL_KEY} AS content_key,
               coalesce(v.vector, '{" ".join(["0"] * HASH_DIM)}') AS vector
        FROM decoded d LEFT JOIN vec v ON v.conv_id = d.conv_id AND v.turn = d.turn""",
    "suffix_targets": f"""WITH {SQL_LABELS}, {_sql_anchors(STRIDE)},
        toks AS (SELECT conv_id, turn, pos, unnest(suffix) AS tid, generate_subscripts(suffix, 1) AS o FROM anchors),
        decoded AS (
          SELECT t.conv_id, t.turn, t.pos, string_agg(v.piece, ' ' ORDER BY t.o) AS text
          FROM toks t JOIN vocab v ON v.token_id = t.tid WHERE t.tid % 40 <> 0 GROUP BY t.conv_id, t.turn, t.pos),
        {_sql_hash("decoded", "conv_id, turn, pos")},
        vec AS (SELECT conv_id, turn, pos, {_sql_ints('x', 'j')} AS vector FROM unit GROUP BY conv_id, turn, pos),
        ranked AS (
          SELECT r.conv_id, r.turn, a.pos,
                 row_number() OVER (PARTITION BY r.conv_id, r.turn, r.pos ORDER BY abs(a.pos - r.pos), a.pos) AS near
          FROM resp r JOIN anchors a ON a.conv_id = r.conv_id AND a.turn = r.turn
        ),
        served AS (SELECT conv_id, turn, pos, count(*) AS served FROM ranked WHERE near = 1 GROUP BY conv_id, turn, pos)
        SELECT v.conv_id, v.turn, CAST(v.pos AS BIGINT) AS pos, s.served, v.vector
        FROM vec v JOIN served s ON s.conv_id = v.conv_id AND s.turn = v.turn AND s.pos = v.pos""",
    "sample_vector_positions": f"""WITH {SQL_LABELS}
        SELECT r.conv_id, r.turn, CAST(r.pos AS BIGINT) AS pos, {_SQL_KEY} AS content_key
        FROM resp r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn""",
    "mean_pool": f"""WITH flat AS (
          SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings),
        m AS (SELECT label, j, avg(x) AS x FROM flat GROUP BY label, j)
        SELECT CAST(label AS BIGINT) AS label, {_sql_ints('x', 'j')} AS vector FROM m GROUP BY label""",
    "vector_distances": """WITH flat AS (
          SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings),
        p AS (SELECT *, avg(x) OVER (PARTITION BY label, j) AS m FROM flat)
        SELECT vec_id,
          round(1 - sum(x * m) / (greatest(sqrt(sum(x * x)), 1e-8) * greatest(sqrt(sum(m * m)), 1e-8)), 8) AS cosine_distance,
          round(avg((x - m) * (x - m)), 8) AS mean_squared
        FROM p GROUP BY vec_id""",
    "interpolation_pairs": f"""WITH flat AS (
          SELECT vec_id, label, unnest(embedding)::DOUBLE AS z1, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
        d AS (SELECT *, md5('7:z:' || vec_id || '#' || j) AS h, {_SQL_T} AS t FROM flat),
        n AS (SELECT *, sqrt(-2 * ln({_SQL_UNIT.format('substr(h, 1, 8)')}))
                        * cos(2 * pi() * {_SQL_UNIT.format('substr(h, 9, 8)')}) AS z0 FROM d)
        SELECT vec_id, round(any_value(t), 9) AS t, {_sql_ints('t * z1 + (1 - t) * z0', 'j')} AS z_t,
               {_sql_ints('z1 - z0', 'j')} AS v
        FROM n GROUP BY vec_id""",
    "linear_cka": _sql_cka("'all'"),
    "linear_cka_by_label": _sql_cka("CAST(label AS VARCHAR)"),
}
