"""Near-duplicates by DartMinHash signatures, joined by bands and verified.

A text is the multiset of its runs of five words. Darts are thrown, by hash, at a
plane of weight and rank for every run; those that fall below the run's weight hit,
and each coordinate of the signature keeps the hit of lowest rank. Two texts agree
in a coordinate with the probability of their weighted Jaccard similarity. The
plane is cut into cells with Poisson numbers of darts, and only cells below a rank
that promises enough hits are looked at, so the cost is the number of runs plus the
length of the signature, not their product.

Texts that share a band are candidates. A bucket is never expanded into pairs: its
members are compared with its most connected member, the centre, exactly. What the
comparisons tell about two members that are still apart settles most of the rest: they
can only be alike if one is little more than what it shares with the centre, which
their sizes show, or if they share runs that the centre and most other members lack.
Such pairs are compared as well, however little of a member the centre has. So no link
between texts that share a band is lost.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import stored, table
from sievecraft.llm.shingles import counted, mix, run_hashes, text_batches, word_hashes

WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
FEW = 32
PER_TASK = 256  # members that one copy of a centre is compared with
_LOW = -6  # the lowest rank cell is [0, 2**-6)
_SEED = np.uint64(0x5851F42D4C957F2D)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers by inverting the distribution function."""
    top = int(mean + 12 * mean**0.5 + 20)
    logs = np.arange(top) * np.log(mean) - mean
    logs[1:] -= np.cumsum(np.log(np.arange(1, top)))
    return np.searchsorted(np.cumsum(np.exp(logs)), u, side="right")


def signatures(text: np.ndarray, item: np.ndarray, weight: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature (texts x k) of weighted sets, and which texts have one (no items: none).

    ``text`` numbers the set of each item; weights are positive reals.
    """
    total = np.bincount(text, weight, texts)
    out, missing = np.zeros((texts, k), np.uint64), total > 0
    has = missing.copy()
    limit = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(texts), where=has)
    while missing.any():
        mine = missing[text]
        rank, hit, place = _darts(text[mine], item[mine], weight[mine], limit, k)
        order = np.argsort(-rank, kind="stable")
        flat = np.zeros(texts * k, np.uint64)
        seen = np.zeros(texts * k, np.bool_)
        flat[place[order]] = hit[order]  # the last to be written has the lowest rank
        seen[place] = True
        whole = missing & seen.reshape(texts, k).all(axis=1)
        out[whole] = flat.reshape(texts, k)[whole]
        missing &= ~whole
        limit = limit * 2
    return out, has


def _darts(text, item, weight, limit, k):
    """Rank, identity and coordinate of the darts below weight and rank limit."""
    ranks, hits, places = [], [], []
    top_weight, top_rank = weight.max(), limit[text].max()
    v = 0
    while v == 0 or 2.0 ** (v - 1) < top_weight:
        w_low, w_width = (0.0, 1.0) if v == 0 else (2.0 ** (v - 1), 2.0 ** (v - 1))
        in_v = np.flatnonzero(weight > w_low)
        r = 0
        while r == 0 or 2.0 ** (_LOW + r - 1) < top_rank:
            r_low, r_width = (0.0, 2.0**_LOW) if r == 0 else (2.0 ** (_LOW + r - 1), 2.0 ** (_LOW + r - 1))
            at = in_v[limit[text[in_v]] > r_low]
            seed = mix(item[at] ^ mix(np.array([v * 4096 + r + 1], np.uint64) * _SEED))
            number = _poisson(_unit(seed), w_width * r_width)
            at, seed = np.repeat(at, number), np.repeat(seed, number)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(seed + (nth.astype(np.uint64) + np.uint64(1)) * _SEED)
            rank = r_low + r_width * _unit(mix(dart + np.uint64(1)))
            hit = (w_low + w_width * _unit(mix(dart + np.uint64(2))) < weight[at]) & (rank < limit[text[at]])
            at, dart = at[hit], dart[hit]
            ranks.append(rank[hit])
            hits.append(dart)
            places.append(text[at] * k + (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64))
            r += 1
        v += 1
    return np.concatenate(ranks), np.concatenate(hits), np.concatenate(places)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * _SEED + signature[:, b * rows + r])
        out[:, b] = h
    return out


def sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc, content and text -> doc, content, bands (none for a text without words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in text_batches(raw):
                words, first, _, _ = word_hashes(raw[a:b])
                number, item, times = counted(*run_hashes(words, first, width))
                signature, has = signatures(number, item, times.astype(np.float64), b - a, bands * rows)
                keys = band_keys(signature[has], bands, rows).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(has))).astype(np.int32) * bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(a, b - a),
                        batch.column("content").slice(a, b - a),
                        pa.ListArray.from_arrays(ends, keys.ravel()),
                    ],
                    ["doc", "content", "bands"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc {kind}, content binary, bands array<long>")


def compared(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Exact comparison of (centre, member) pairs.

    ``alike`` tells whether the weighted Jaccard similarity reaches the bound, ``size``
    is the number of runs of the member, ``common`` how many of them the centre has,
    ``others`` the runs that the centre lacks, with their number.

    ``texts`` has (node, text). A centre's text is copied once per ``PER_TASK``
    members, and a task reads centre and members in order, one at a time.
    """
    copies = pairs.groupBy("centre").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("copies"))
    members = pairs.join(copies, "centre").select(
        "centre", "member", F.pmod(F.xxhash64("member"), F.col("copies")).cast("int").alias("copy")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    centres = copies.select("centre", F.col("centre").alias("member"), every.alias("copy"))
    rows = (
        members.withColumn("own", F.lit(1))
        .unionByName(centres.withColumn("own", F.lit(0)))
        .join(texts.withColumnRenamed("node", "member"), "member")
        .repartition("centre", "copy")
        .sortWithinPartitions("centre", "copy", "own", "member")
        .select("centre", "member", "own", "text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            found, alike, sizes, commons, runs, numbers, ends = [], [], [], [], [], [], [0]
            raw = batch.column(3).cast(pa.binary()).to_pylist()
            left, own = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in text_batches(raw):
                words, first, _, _ = word_hashes(raw[a:b])
                number, item, times = counted(*run_hashes(words, first, width))
                cut = np.searchsorted(number, np.arange(b - a + 1))
                for i in range(a, b):
                    part = slice(cut[i - a], cut[i - a + 1])
                    if not own[i]:
                        centre = left[i], item[part], times[part], times[part].sum()
                        continue
                    if centre is None or centre[0] != left[i]:
                        raise RuntimeError(f"no text for {left[i]!r}")
                    _, x, y = np.intersect1d(centre[1], item[part], True, True)
                    more = times[part].copy()
                    both = np.minimum(centre[2][x], more[y])
                    more[y] -= both
                    size, common = int(times[part].sum()), int(both.sum())
                    lacks = np.flatnonzero(more)
                    found.append(i)
                    alike.append(common >= similarity * (centre[3] + size - common) - 1e-9)
                    sizes.append(size)
                    commons.append(common)
                    runs.append(item[part][lacks].view(np.int64))
                    numbers.append(more[lacks].astype(np.int64))
                    ends.append(ends[-1] + len(lacks))
            at = pa.array(found, pa.int64())
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (runs, numbers)]
            others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["run", "n"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(alike, pa.bool_()),
                 pa.array(sizes, pa.int64()), pa.array(commons, pa.int64()), others],
                ["centre", "member", "alike", "size", "common", "others"],
            )

    return rows.mapInArrow(
        work, "centre binary, member binary, alike boolean, size long, common long, others array<struct<run:long,n:long>>"
    )


def with_frequent_runs(family: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The family with ``common`` counted against the centre and what many of its members have, and the other runs.

    Any set will do as a centre for the bounds. With the runs that more than ``FEW``
    members have, although the centre lacks them, it is nearer to all of them,
    and no run that remains has more than ``FEW`` members.
    """
    every = family.select("centre", "member", F.explode("others").alias("o")).select("centre", "member", "o.run", "o.n")
    counts = every.groupBy("centre", "run").agg(F.count("*").alias("members")).where("members > 1")
    every = stored(every.join(counts, ["centre", "run"]), "others")
    more = every.where(F.col("members") > FEW).groupBy("centre", "member").agg(F.sum("n").alias("more"))
    near = family.drop("others").join(more, ["centre", "member"], "left")
    near = near.withColumn("common", F.col("common") + F.coalesce("more", F.lit(0))).drop("more")
    return stored(near, "near"), every.where(F.col("members") <= FEW)


def pairs_by_run(near: DataFrame, others: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of a centre with a rare run in common that the centre lacks.

    Alike members share at least ``similarity * size - common`` of such runs, so it is
    enough to file each under its rarest ones: those with at least that many of its
    runs from there on. Runs of one member alone come first and are filed nowhere.
    """
    mine = Window.partitionBy("centre", "member").orderBy("members", "run")
    from_here = F.sum("n").over(mine.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filed = others.join(near, ["centre", "member"]).withColumn("behind", from_here)
    filed = filed.where(F.col("behind") >= similarity * F.col("size") - F.col("common") - 1e-9)
    x = filed.select("centre", "run", F.col("member").alias("a"), F.col("label").alias("of"))
    y = filed.select("centre", "run", F.col("member").alias("b"), "label")
    pairs = x.join(y, ["centre", "run"]).where("a < b AND label <> of")
    return pairs.select(F.col("a").alias("centre"), F.col("b").alias("member"))


def short_pairs(family: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of a centre that may be alike without sharing a run that the centre lacks.

    With x the one that shares less with the centre, at most ``x.common`` runs are in
    both, so alike texts need ``y.size <= x.common / similarity - x.extra``, and
    ``y.size >= y.common >= x.common``. Sizes are joined by bins of five percent.
    """
    place = lambda size: F.floor(F.log(size.cast("double")) / F.log(F.lit(1.05)) + 1e-9)
    top = F.floor(F.col("common") / similarity - (F.col("size") - F.col("common")) + 1e-9)
    x = family.select("centre", F.col("member").alias("a"), F.col("label").alias("of"), F.col("common").alias("least"), top.alias("top"))
    x = x.where("top >= least AND least > 0").withColumn("bin", F.explode(F.sequence(place(F.col("least")), place(F.col("top")))))
    y = family.select("centre", F.col("member").alias("b"), "label", "size", "common", place(F.col("size")).alias("bin"))
    return (
        x.join(y, ["centre", "bin"])
        .where("label <> of AND size <= top AND (common > least OR common = least AND b > a)")
        .select(F.col("a").alias("centre"), F.col("b").alias("member"))
        .distinct()
    )


def stars(buckets: DataFrame) -> DataFrame:
    """(centre, member) pairs of the (key, node) buckets with two nodes or more.

    A node's weight is the number of nodes it meets in all its buckets; the heaviest
    node of a bucket, of equals the first, is its centre.
    """
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(buckets.join(shared, "key"), "buckets")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = members.drop("n").join(weight, "node")
    centre = F.max_by("node", F.struct("weight", "node")).alias("centre")
    centres = weighed.groupBy("key").agg(centre)
    return members.join(centres, "key").where("node <> centre").select("centre", F.col("node").alias("member")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node that it is connected with), for the nodes of (a, b) edges.

    Each round takes the smallest label among the neighbours and then the label of
    that label; rounds are stored, and end when no label changes.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = stored(edges.select("a", "b").unionByName(turned).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        step = lower.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("lower", "low")).alias("label"), F.col("label").alias("old")
        )
        step = stored(step, "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``content`` (MD5 of the text), ``class_id``, ``n_copies``,
    ``class_content`` (the content that names the class, should ids repeat).

    ``class_id`` is the smallest id of the texts that are linked, directly or through
    others, by a weighted Jaccard similarity of at least ``similarity``; ``n_copies``
    counts the rows of the very same text. A text of fewer than ``width`` words is
    one run. Null, empty and wordless texts are alone, even among each other. Rows
    that share an id and a text get one row each. A row without an id gets the class
    of its text, null if only rows without an id have that text. An empty table gives
    no row. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("content"), F.col(text).alias("text"))
    signed = stored(sign(docs, width, bands, rows), "signed")
    contents = stored(
        signed.where("size(bands) > 0")
        .groupBy("content")
        .agg(F.min("doc").alias("rep"), F.count("*").alias("n_copies"), F.min("bands").alias("bands")),
        "contents",
    )
    buckets = contents.where("rep IS NOT NULL").select(F.col("content").alias("node"), F.explode("bands").alias("key"))
    pairs = stored(stars(buckets), "pairs")
    wanted = pairs.select(F.explode(F.array("centre", "member")).alias("content")).distinct().join(contents, "content")
    texts = stored(
        docs.join(wanted.select(F.col("rep").alias("doc"), "content"), ["doc", "content"], "left_semi").select(
            F.col("content").alias("node"), "text"
        ),
        "texts",
    )
    labels = None
    if not pairs.isEmpty():
        family = stored(compared(pairs, texts, width, similarity), "compared")
        links = family.where("alike").select(F.col("centre").alias("a"), F.col("member").alias("b"))
        labels = components(links)
        family = family.join(labels.withColumnRenamed("node", "member"), "member", "left")
        family = family.withColumn("label", F.coalesce("label", "member"))
        apart = family.groupBy("centre").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        near, others = with_frequent_runs(stored(family.join(apart.select("centre"), "centre"), "apart"))
        again = pairs_by_run(near, others, similarity).unionByName(short_pairs(near, similarity)).distinct()
        again = stored(again, "pairs")
        if not again.isEmpty():
            found = stored(compared(again, texts, width, similarity), "compared").where("alike")
            labels = components(links.unionByName(found.select(F.col("centre").alias("a"), F.col("member").alias("b"))))
    classes = contents.select("content", "rep", "n_copies")
    if labels is None:
        classes = classes.withColumn("class_id", F.col("rep")).withColumn("label", F.col("content"))
    else:
        classes = stored(
            classes.join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content")),
            "classes",
        )
        smallest = classes.groupBy("label").agg(F.min("rep").alias("class_id"))
        classes = classes.join(smallest, "label")
    return signed.select("doc", "content").join(classes.select("content", "class_id", "n_copies", "label"), "content", "left").select(
        F.col("doc").alias(doc_id),
        "content",
        F.when(F.col("n_copies").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("label", "content").alias("class_content"),
    )


def op4_dart_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its class; classes are linked by similarities of 0.8 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_copies")


QUERIES = {"op4_dart_minhash": op4_dart_minhash}
ORACLE: dict[str, str] = {}
