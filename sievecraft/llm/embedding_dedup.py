"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

Two vectors are compared only if they have the same label and length. The vectors of
a large label are dealt to cells, those whose centre has the largest cosine. No link
is lost at the border of cells: let u and v be unit vectors with |u - v| <= d, the
distance of two vectors at the bound. Their midpoint lies in some cell, at most d / 2
from either, so each of the two is at most d / 2 behind every bisecting plane that
separates it from that cell. A vector is therefore put into its own cell and into all
cells that are so close; the pair meets in one of them at least. Pairs of one own
cell count there, others in the first cell that both are in, so each counts once.

Members of a cell within half of the bound's angle of its centre, its core, are all
linked with each other, so a large group of near copies is counted and not compared.
Everything else meets in tiles of two blocks of bounded size. A tile hands on sums of
links and one edge for each linked vector, never pairs.

Vectors without any cluster structure lie close to all bisecting planes in many
dimensions; they are put into most cells of their label, and the work is that of
comparing all vectors of the label, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import stored, table
from sievecraft.llm.dart_minhash import components

SIMILARITY = 0.93
CELL_ROWS = 2048  # wanted vectors of a cell
BLOCK_ROWS, BLOCK_BYTES = 2048, 32 << 20  # of one side of a tile
MAX_CELLS, CENTRE_BYTES = 4096, 32 << 20  # centres that are broadcast: twice that number at most
SAMPLE_ROWS = 64  # vectors that a centre is fitted on, about
_CHUNK_BYTES = 32 << 20
_SLACK = 1e-9


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows divided by their length, taken apart from their largest entry so that nothing overflows."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def fit_centres(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` unit centres of spherical k-means; the start is drawn with a fixed seed."""
    rng = np.random.default_rng(len(rows))
    k = min(k, len(rows))
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        home, score = np.empty(len(rows), np.int64), np.empty(len(rows))
        for at in _chunks(len(rows), 8 * k):
            s = rows[at] @ centres.T
            home[at] = s.argmax(axis=1)
            score[at] = s[np.arange(len(s)), home[at]]
        order = np.argsort(home, kind="stable")
        filled, first = np.unique(home[order], return_index=True)
        sums = np.zeros_like(centres)
        sums[filled] = np.add.reduceat(rows[order], first, axis=0)
        length = np.sqrt((sums * sums).sum(axis=1))
        # an empty or balanced cell starts again at one of the vectors that fit their cell least
        spare = np.argsort(score, kind="stable")[: int((length < 1e-12).sum())]
        sums[length < 1e-12] = rows[spare]
        length[length < 1e-12] = 1.0
        centres = sums / length[:, None]
    return centres


def _chunks(n: int, row_bytes: int) -> Iterator[slice]:
    step = max(1, _CHUNK_BYTES // row_bytes)
    return (slice(k, min(n, k + step)) for k in range(0, n, step))


def cells_of(units: np.ndarray, centres: np.ndarray, apart: np.ndarray, half: float) -> Iterator[tuple]:
    """For each unit vector its own cell, its cosine with the centre, and all cells that it is put into.

    ``apart`` has the distances of the centres, ``half`` is half of the bound's distance.
    """
    for at in _chunks(len(units), 8 * len(centres)):
        s = units[at] @ centres.T
        home = s.argmax(axis=1)
        best = s[np.arange(len(s)), home]
        near = best[:, None] - s <= (half + _SLACK) * apart[home] + _SLACK
        for k in range(len(s)):
            yield int(home[k]), float(best[k]), np.flatnonzero(near[k]).astype(np.int32)


def _unit_table(batch: pa.RecordBatch) -> tuple[list, list, list]:
    """(group, node, unit vector as bytes) of a batch of id, label, vec; None where a vector can't be compared."""
    groups, nodes, units = [], [], []
    import hashlib

    for label, vec in zip(batch.column("label").to_pylist(), batch.column("vec")):
        row = None if label is None or not vec.is_valid else vec.values
        x = None if row is None or row.null_count or not len(row) else row.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        if x is None or not np.isfinite(x).all() or not x.any():
            groups.append(None), nodes.append(None), units.append(None)
            continue
        group = f"{len(x)}:{label}"
        groups.append(group)
        nodes.append(hashlib.blake2b(x.tobytes(), digest_size=16, key=hashlib.sha256(group.encode()).digest()).digest())
        units.append(unit_rows(x[None])[0].tobytes())
    return groups, nodes, units


def signed(vectors: DataFrame) -> DataFrame:
    """id, group, node (the same for equal vectors of one label), unit vector as bytes."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, nodes, units = _unit_table(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(groups, pa.string()), pa.array(nodes, pa.binary()), pa.array(units, pa.binary())],
                ["id", "grp", "node", "unit"],
            )

    return vectors.mapInArrow(work, f"id {id_type}, grp string, node binary, unit binary")


def fitted_centres(classes: DataFrame, cell_rows: int, sample_rows: int) -> dict[str, np.ndarray]:
    """Centres of every group of more than ``cell_rows`` different vectors.

    There are at most about MAX_CELLS centres, of CENTRE_BYTES; beyond that cells get
    more vectors. They are fitted on some ``sample_rows`` vectors each.
    """
    total = classes.agg(F.count("*").alias("n"), F.max(F.length("unit")).alias("width")).first()
    if not total.n:
        return {}
    most = max(1, min(MAX_CELLS, CENTRE_BYTES // total.width))
    target = max(cell_rows, math.ceil(total.n / most))
    large = classes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > target)
    wanted = large.select("grp", F.ceil(F.col("n") / target).cast("int").alias("k"), "n")
    share = F.xxhash64("node").bitwiseAND(F.lit((1 << 30) - 1)) < F.col("k") * F.lit(float(sample_rows << 30)) / F.col("n")
    sample = classes.select("grp", "node", "unit").join(F.broadcast(wanted), "grp").where(share)

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        units = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(rows.num_rows, -1)
        centres = fit_centres(units, rows.column("k")[0].as_py())
        return pa.table({"grp": pa.array([rows.column("grp")[0].as_py()]), "centres": pa.array([centres.tobytes()], pa.binary()), "k": pa.array([len(centres)], pa.int32())})

    found = sample.groupBy("grp").applyInArrow(fit, "grp string, centres binary, k int").collect()
    return {r.grp: np.frombuffer(r.centres, np.float64).reshape(r.k, -1) for r in found}


def dealt(classes: DataFrame, centres: dict[str, np.ndarray], similarity: float) -> DataFrame:
    """Classes with ``home``, ``core`` and ``cells``; a group without centres is one cell."""
    angle = math.acos(similarity)
    half, core_from = math.sqrt(2 - 2 * similarity) / 2, math.cos(max(0.0, angle / 2 - 1e-7))
    held = classes.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {g: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) for g, c in held.value.items() if len(c) <= 1024}
        for batch in batches:
            groups, units = batch.column("grp").to_pylist(), batch.column("unit").to_pylist()
            home, core, cells = [0] * len(groups), [False] * len(groups), [[0]] * len(groups)
            for g in set(groups) & held.value.keys():
                at = [k for k, x in enumerate(groups) if x == g]
                c = held.value[g]
                between = apart[g] if g in apart else np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
                u = np.frombuffer(b"".join([units[k] for k in at]), np.float64).reshape(len(at), -1)
                for k, (h, s, near) in zip(at, cells_of(u, c, between, half)):
                    home[k], core[k], cells[k] = h, s >= core_from, near
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home, pa.int32()), pa.array(core, pa.bool_()), pa.array(cells, pa.list_(pa.int32()))],
                [*batch.schema.names, "home", "core", "cells"],
            )

    return classes.mapInArrow(work, "node binary, n long, grp string, unit binary, home int, core boolean, cells array<int>")


def tiles(entries: DataFrame, block_rows: int) -> DataFrame:
    """Each entry once for every tile that its block is in.

    Blocks of vectors outside the core meet each other and those of the core; two
    vectors of the core never meet. Blocks are filled by the hash of the vector.
    """
    sizes = entries.groupBy("grp", "cell").agg(F.count(F.when(~F.col("core"), 1)).alias("rest"), F.count(F.when(F.col("core"), 1)).alias("core_n"))
    blocks = sizes.select(
        "grp", "cell", *[F.ceil(F.col(c) / block_rows).cast("int").alias(b) for c, b in (("rest", "rest_blocks"), ("core_n", "core_blocks"))]
    ).where("rest_blocks > 0")
    own = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("core"), F.col("core_blocks")).otherwise(F.col("rest_blocks")), F.lit(1))).cast("int")
    numbered = entries.join(blocks, ["grp", "cell"]).withColumn("own", own)

    def counted(n: str):
        return F.filter(F.sequence(F.lit(0), F.col(n)), lambda j: j < F.col(n))

    def tile(kind: int, a, b, side):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))

    among = F.transform(counted("rest_blocks"), lambda j: tile(0, F.least("own", j), F.greatest("own", j), F.col("own") > j))
    with_core = F.transform(counted("core_blocks"), lambda j: tile(1, F.col("own"), j, F.lit(0)))
    of_core = F.transform(counted("rest_blocks"), lambda j: tile(1, j, F.col("own"), F.lit(1)))
    met = F.when(F.col("core"), of_core).otherwise(F.concat(among, with_core))
    return numbered.select("grp", "cell", "node", "n", "unit", "home", "cells", F.inline(met))


def _lower_cells(cells: list[np.ndarray], cell: int) -> np.ndarray | None:
    """Bit sets of the cells before ``cell``, or None where there is none."""
    lower = [c[c < cell] for c in cells]
    if not any(len(c) for c in lower):
        return None
    bits = np.zeros((len(lower), (cell + 63) // 64), np.uint64)
    for k, c in enumerate(lower):
        np.bitwise_or.at(bits[k], c >> 6, np.uint64(1) << (c & 63).astype(np.uint64))
    return bits


def linked(u: np.ndarray, v: np.ndarray, home: tuple, lower: tuple, cell: int, similarity: float) -> np.ndarray:
    """Which of u and v are linked and count in this cell."""
    out = np.zeros((len(u), len(v)), bool)
    for at in _chunks(len(u), 8 * len(v)):
        i, j = np.nonzero(u[at] @ v.T >= similarity)
        i += at.start
        same = home[0][i] == home[1][j]
        counts = ~same | (home[0][i] == cell)
        if lower[0] is not None and lower[1] is not None:
            for part in _chunks(len(i), 8 * lower[0].shape[1]):
                met = (lower[0][i[part]] & lower[1][j[part]]).any(axis=1)
                counts[part] &= same[part] | ~met
        out[i[counts], j[counts]] = True
    return out


def connected(links: np.ndarray, alone: bool) -> np.ndarray:
    """Component numbers (of the first member) of the rows and then the columns; -1 without links.

    ``alone``: rows and columns are the same vectors, and only the rows are numbered.
    """
    rows = len(links)
    label = np.full(rows if alone else sum(links.shape), -1)
    for start in np.flatnonzero(links.any(axis=1)):
        if label[start] >= 0:
            continue
        label[start], frontier = start, [start]
        while frontier:
            k = frontier.pop()
            near = np.flatnonzero(links[:, k - rows]) if k >= rows else np.flatnonzero(links[k]) + (0 if alone else rows)
            new = near[label[near] < 0]
            label[new] = start
            frontier.extend(new.tolist())
    return label


def compared(tiled: DataFrame, similarity: float) -> DataFrame:
    """node, links (rows that it is linked with in the tile), root (of its component in the tile)."""

    def compare(rows: pa.Table) -> pa.Table:
        cell, kind, a, b = (rows.column(c)[0].as_py() for c in ("cell", "kind", "a", "b"))
        rows = rows.sort_by("node")
        side = rows.column("side").to_numpy()
        parts = [np.flatnonzero(side == k) for k in (0, 1)]
        alone = kind == 0 and a == b
        if alone:
            parts[1] = parts[0]
        nodes, n, home = rows.column("node").to_pylist(), rows.column("n").to_numpy(), rows.column("home").to_numpy()
        unit, cells = rows.column("unit").to_pylist(), [np.array(c) for c in rows.column("cells").to_pylist()]
        units = [np.frombuffer(b"".join([unit[k] for k in p]), np.float64).reshape(len(p), -1) if len(p) else None for p in parts]
        out: dict[str, list] = {"node": [], "links": [], "root": []}
        if len(parts[0]) and len(parts[1]):
            lower = [_lower_cells([cells[k] for k in p], cell) for p in parts]
            found = linked(*units, [home[p] for p in parts], lower, cell, similarity)
            if alone:
                np.fill_diagonal(found, False)
            label = connected(found, alone)
            own = np.concatenate(parts)
            counts = np.concatenate([found @ n[parts[1]], found.T @ n[parts[0]]])
            for k in np.flatnonzero(label >= 0):
                out["node"].append(nodes[own[k]]), out["links"].append(int(counts[k])), out["root"].append(nodes[own[label[k]]])
        return pa.table({"node": pa.array(out["node"], pa.binary()), "links": pa.array(out["links"], pa.int64()), "root": pa.array(out["root"], pa.binary())})

    return tiled.groupBy("grp", "cell", "kind", "a", "b").applyInArrow(compare, "node binary, links long, root binary")


def near_duplicate_vectors(
    df: DataFrame,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    label: str = "label",
    similarity: float = SIMILARITY,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``df``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows of the same label with a cosine of at least
    ``similarity``, equal vectors included; ``component_id`` is the smallest id that is
    reachable over links; one row of each component, that of this id, is kept. A row
    without label, or whose vector is null, empty, zero, of another length or holds
    nulls, NaN or infinities is linked with nothing. A row without an id counts as a
    link; it is kept only if its component has no id at all. Of rows that share the
    smallest id of a component all are kept. An empty table gives no row. Other columns
    are not read.
    """
    rows = df.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    rows = stored(signed(rows), "vectors")
    classes = stored(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.first("grp").alias("grp"), F.first("unit").alias("unit")),
        "vector-classes",
    )
    centres = fitted_centres(classes, cell_rows, sample_rows)
    width = max([c.shape[1] for c in centres.values()], default=0)
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * width) if width else block_rows))
    placed = stored(dealt(classes.select("node", "n", "grp", "unit"), centres, similarity), "vector-cells")
    found = stored(compared(tiles(placed.withColumn("cell", F.explode("cells")).withColumn("core", F.expr("core AND home = cell")), block_rows), similarity), "vector-links")
    # the cells that have a core are no more than the centres
    cores = placed.where("core").groupBy("grp", "home").agg(F.sum("n").alias("core_n"), F.min("node").alias("root"))
    in_core = stored(
        placed.where("core").join(F.broadcast(cores), ["grp", "home"]).select("node", (F.col("core_n") - F.col("n")).alias("links"), "root"), "vector-cores"
    )
    links = found.unionByName(in_core)
    edges = links.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    labels = components(edges)
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "n", "rep").join(sums, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = stored(known, "vector-components")
    smallest = known.where("label <> node OR links IS NOT NULL").groupBy("label").agg(F.min("rep").alias("least"))
    known = known.join(smallest, "label", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("least")).alias("least")
    )
    out = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def op13_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its component and whether it represents it."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_near_dedup": op13_embedding_near_dedup}
ORACLE = {
    "op13_embedding_near_dedup": """
WITH RECURSIVE
usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER () AS r FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, l.b) AS component_id, least(e.vec_id, l.b) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""
}
