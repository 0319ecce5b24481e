"""Prefix trie of conversations, and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns. Its key is a sum of hashes of (place,
turn), kept in four lanes: each place occurs once in a sequence, so the sum identifies
it, and sums over a conversation are taken over stretches of it side by side, however
long it is.

Sums over subtrees come from splitting the forest of parent edges at centroids. The
weight of a subtree is the number of turns of all members below, known from one
aggregate. The nodes of a component with half of its weight or more form a path down
from its top; the last of them is the centroid. Without it the component falls into
the part above and one part below each child, none of more than half of the weight. A
round splits all components, adds up what lies at and below each centroid, and adds
this total to the nodes on the path from the centroid to the top. Rounds are as many
as the logarithm of the weight, be the trie flat or one long chain; a round is a few
joins and aggregates over narrow rows, dealt by component and a salt, so that one
component of all nodes is spread as well. Components of a few thousand nodes are split
to the end in one task each, by the same recursion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import stored, table
from sievecraft.operators.ordering import number_rows

STRETCH = 4096  # turns of a conversation, or of a path, that are handled together
_LANES, _DIGITS = 4, 10  # of ten hexadecimal digits
_LANE = 1 << (4 * _DIGITS)
NODES_A_SALT = 1 << 16
LOCAL_NODES = 4096  # of a component that one task splits to the end
IDS_A_PIECE = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), code (digest of role and text), n_words, in the order of ``turn``, nulls first.

    Equal turns are ordered by role and then by the SHA-256 of the text. Null roles and
    texts are empty. Rows without a conversation belong to none and are left out.
    """
    said = df.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    coded = said.select(
        "conv", "turn", "role", F.sha2("text", 256).alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    )
    ranked = number_rows(coded, ["turn", "role", "digest"], "pos", by=["conv"])
    return ranked.select("conv", "pos", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "digest"), 256)).alias("code"), "n_words")


def with_shared_heads(turns: DataFrame, family: Column, heads: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another one: (turns, conversations).

    The first ``heads`` turns of a conversation are replaced by those of conversation
    ``family``, as many as it has. ``turns`` gets ``left``, the number of turns from
    here to the end; conversations have ``conv`` and ``length``, which may be 0.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    wanted = sizes.select("conv", "n", family.alias("base"), heads.alias("h"))
    given = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = stored(
        wanted.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
            "conv", "base", "h", given.alias("given"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
        ),
        "conversations",
    )
    own = turns.join(convs, "conv").where("pos >= h").withColumn("pos", F.expr("pos - h + given"))
    # the longest head bounds what is read of a base, and conversations of a base are those of one family
    longest = convs.agg(F.max("given")).scalar()
    first = turns.where(F.col("pos") < longest).select(F.col("conv").alias("base"), "pos", "code", "n_words")
    head = first.join(convs, "base").where("pos < given")
    out = own.select(*(columns := ("conv", "pos", "code", "n_words", "length"))).unionByName(head.select(*columns))
    return out.withColumn("left", F.col("length") - F.col("pos")).drop("length"), convs.select("conv", "length")


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *lanes)))


def root_key() -> Column:
    return _key(F.lit(0), [F.lit(0)] * _LANES)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, key, parent, n_words, left of every prefix of one turn or more."""
    hashed = F.sha2(F.concat("code", F.col("pos").cast("string").cast("binary")), 256)
    lanes = [f"lane{k}" for k in range(_LANES)]
    with_hash = turns.withColumn("stretch", F.floor(F.col("pos") / STRETCH)).withColumn("hash", hashed)
    own = with_hash.withColumns({c: F.conv(F.substr("hash", F.lit(1 + k * _DIGITS), F.lit(_DIGITS)), 16, 10).cast("long") for k, c in enumerate(lanes)}).drop("hash", "code")
    so_far = Window.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = stored(own.withColumns({f"sum_{c}": F.sum(c).over(so_far) for c in lanes}), "turn-hashes")
    # only conversations of several stretches have anything to add
    whole = local.groupBy("conv", "stretch").agg(*[F.pmod(F.sum(c), F.lit(_LANE)).alias(c) for c in lanes], F.count("*").alias("n"))
    many = whole.where(F.col("n") == STRETCH)
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    offsets = many.select("conv", (F.col("stretch") + 1).alias("stretch"), *[F.sum(c).over(before).alias(f"before_{c}") for c in lanes])
    full = local.join(offsets, ["conv", "stretch"], "left")
    after = [F.pmod(F.col(f"sum_{c}") + F.coalesce(f"before_{c}", F.lit(0)), F.lit(_LANE)) for c in lanes]
    prior = [F.pmod(F.col(f"sum_{c}") + F.coalesce(f"before_{c}", F.lit(0)) - F.col(c), F.lit(_LANE)) for c in lanes]
    return full.select("conv", (F.col("pos") + 1).alias("depth"), _key(F.col("pos") + 1, after).alias("key"), _key(F.col("pos"), prior).alias("parent"), "n_words", "left")


def trie_nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """key, parent, depth, n_words, conv (smallest member), n_convs, weight; the root has no parent."""
    below = paths.groupBy("key", "parent", "depth", "n_words").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum("left").alias("weight"))
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    top = root.select(root_key().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_words"), "conv", "n_convs", "weight")
    return below.unionByName(top)


def split_in_memory(parents: list[int], weights: list[int], values: list[list[int]]) -> list[list[int]]:
    """``rollup`` of a forest of a few thousand nodes; ``parents`` has -1 at the tops."""
    children: list[set[int]] = [set() for _ in parents]
    for node, up in enumerate(parents):
        if up >= 0:
            children[up].add(node)
    sums = [[0] * len(parents) for _ in values]
    tops = [node for node, up in enumerate(parents) if up < 0]
    while tops:
        top = tops.pop()
        path = [top]
        while (heavy := next((k for k in children[path[-1]] if 2 * weights[k] >= weights[top]), None)) is not None:
            path.append(heavy)
        centre, below = path[-1], [path[-1]]
        for node in below:  # grows while it is read
            below.extend(children[node])
        for value, total in zip(values, sums):
            part = sum(value[k] for k in below)
            for node in path:
                total[node] += part
        for node in path[:-1]:
            weights[node] -= weights[centre]
        tops.extend(children[centre])
        children[centre] = set()
        if centre != top:
            children[path[-2]].discard(centre)
            tops.append(top)
    return sums


def _finished(components: DataFrame, n: int, values: list[str]) -> DataFrame:
    """key and sums of components of at most LOCAL_NODES nodes, some of them in a group, each group in one call."""

    def work(rows: pa.Table) -> pa.Table:
        keys, comps = rows.column("key").to_pylist(), rows.column("comp").to_pylist()
        place = {k: i for i, k in enumerate(keys)}
        # the top of a component is the node that it is named after
        parents = [-1 if k == c else place[p] for k, c, p in zip(keys, comps, rows.column("parent").to_pylist())]
        sums = split_in_memory(parents, rows.column("weight").to_pylist(), [rows.column(v).to_pylist() for v in values])
        return pa.table({"key": pa.array(keys, pa.binary()), **{v: pa.array(x, pa.int64()) for v, x in zip(values, sums)}})

    group = F.pmod(F.xxhash64("comp"), F.lit(max(1, -(-n // LOCAL_NODES)))).alias("group")
    sums = ", ".join(f"{v} long" for v in values)
    return components.select("key", "parent", "comp", "weight", *values, group).groupBy("group").applyInArrow(work, f"key binary, {sums}")


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """key and the sums of ``values`` over the subtree of each node, the node included.

    ``nodes`` has key, parent, depth, conv, n_children, weight and the values; weights are
    sums over the subtree of positive numbers. ``paths`` has the key and the parent at
    each depth of a conversation, at least down to the nodes that it is the conv of.
    Components of up to LOCAL_NODES nodes are split on in one task by the same recursion.
    """
    partitions, n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count()
    salts = max(partitions, -(-n // NODES_A_SALT))
    stretch = F.floor(F.col("depth") / STRETCH)
    active = nodes.select("key", "parent", "depth", "conv", stretch.alias("stretch"), "weight", "n_children", *values)
    active = active.withColumn("salt", F.pmod(F.xxhash64("conv", "stretch"), F.lit(salts))).withColumn("comp", root_key())
    tops = nodes.where("parent IS NULL").select(F.col("key").alias("comp"), F.col("weight").alias("comp_weight"))
    at_depth = paths.select("conv", F.col("depth").alias("look"), F.col("key").alias("child"), F.col("parent").alias("child_parent"))
    sums = [F.sum(v).alias(v) for v in values]
    parts: list[DataFrame] = []
    small: list[DataFrame] = []
    while True:
        parts_of = active.groupBy("comp", "salt").agg(F.count("*").alias("n"))
        sizes = parts_of.groupBy("comp").agg(F.sum("n").alias("comp_n")).join(tops, "comp")
        weighed = stored(parts_of.drop("n").join(sizes, "comp"), "trie-parts")
        large = weighed.where(F.col("comp_n") > LOCAL_NODES)
        if large.isEmpty():
            small.append(active)
            break
        here = weighed.where(F.col("comp_n") <= LOCAL_NODES).select("comp", "salt")
        small.append(active.join(here, ["comp", "salt"], "left_semi"))
        halves = active.join(large, ["comp", "salt"]).where("2 * weight >= comp_weight")
        centroid = halves.groupBy("comp").agg(F.max(F.struct("depth", "key", "weight")).alias("c"))
        centres = large.join(centroid, "comp").select("comp", "salt", "comp_weight", F.col("c.depth").alias("at"), F.col("c.key").alias("centre"), F.col("c.weight").alias("cut"))
        placed = active.join(centres, ["comp", "salt"])
        # below a child of the centroid, the conversation of a node tells which child that is
        ask = placed.where("depth > at + 1").groupBy("comp", "salt", "conv", "stretch").agg((F.max("at") + 1).alias("look"))
        child = ask.join(at_depth, ["conv", "look"]).select("comp", "salt", "conv", "stretch", "child", "child_parent")
        told = placed.join(child, ["comp", "salt", "conv", "stretch"], "left")
        is_child = (F.col("depth") == F.col("at") + 1) & F.col("parent").eqNullSafe(F.col("centre"))
        state = (
            F.when(F.col("key") == F.col("centre"), F.lit("centre"))
            .when(F.col("depth") <= F.col("at"), F.lit("above"))
            .when(is_child, F.lit("child"))
            .when((F.col("depth") > F.col("at") + 1) & (F.col("child_parent") == F.col("centre")), F.lit("below"))
            .otherwise(F.lit("above"))
        )
        split = told.withColumn("state", state).withColumn("on_path", F.expr("2 * weight >= comp_weight"))
        columns = ["key", "parent", "depth", "conv", "stretch", "salt", "comp", "comp_weight", "weight", "cut", "child", "state", "on_path", "n_children", *values]
        split = stored(split.select(*columns), "trie-round")
        totals = split.where("state <> 'above'").groupBy("comp").agg(*sums)
        spread = large.select("comp", "salt").join(totals, "comp")
        added = split.where("on_path").select("key", "comp", "salt").join(spread, ["comp", "salt"]).select("key", *values)
        # a child without nodes below is a component of its own, and done
        lone = F.expr("state = 'child' AND n_children = 0")
        parts.append(stored(added.unionByName(split.where(lone).select("key", *values)), "trie-sums"))
        rest = split.where(F.col("state") != "centre").where(~lone)
        comp = F.when(F.col("state") == "child", F.col("key")).when(F.col("state") == "below", F.col("child")).otherwise(F.col("comp"))
        cut = F.when(F.col("on_path"), F.col("cut")).otherwise(F.lit(0))
        active = rest.select("key", "parent", "depth", "conv", "stretch", "salt", comp.alias("comp"), (F.col("weight") - cut).alias("weight"), "n_children", *values)
        lower = rest.where("state = 'child'").select(F.col("key").alias("comp"), F.col("weight").alias("comp_weight"))
        upper = rest.where("state = 'above' AND key = comp").select("comp", (F.col("comp_weight") - F.col("cut")).alias("comp_weight"))
        tops = lower.unionByName(upper)
    components = reduce(DataFrame.unionByName, [part.select("key", "parent", "comp", "weight", *values) for part in small])
    parts.append(_finished(components, n, values))
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(*sums)


def _joined(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of the comma-joined ids: bounded pieces of them, hashed one after the other."""
    piece = F.floor(F.col("conv") / IDS_A_PIECE)
    text = F.array_join(F.transform(F.array_sort(F.collect_set("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("key", piece.alias("piece")).agg(text.alias("ids")).repartition("key").sortWithinPartitions("key", "piece")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key), digests.append(state.hexdigest())
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return pieces.mapInArrow(work, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv, pos, code, n_words, left), see ``with_shared_heads``.

    conv_id (smallest member; its first ``depth`` turns are the node's), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words that members need
    not repeat, summed over the subtree), ends_sha256. Without conversations there is no
    node, not even a root.
    """
    paths = stored(prefixes(turns), "trie-paths")
    nodes = stored(trie_nodes(paths, convs), "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    valued = stored(
        nodes.join(children, "key", "left").withColumns(
            {
                "n_children": F.coalesce("n_children", F.lit(0)),
                "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
                "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words"),
            }
        ),
        "trie-values",
    )
    sums = rollup(valued, paths, ["n_leaves", "saved_tokens"])
    deepest = convs.where("length > 0").join(paths.select("conv", F.col("depth").alias("length"), "key"), ["conv", "length"]).select("key", "conv")
    ends = deepest.unionByName(convs.where("length = 0").select(root_key().alias("key"), "conv"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = valued.drop("n_leaves", "saved_tokens").join(parents, "parent", "left").join(sums, "key").join(_joined(ends), "key", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the head of the first one of its twenty."""
    turns = stored(numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return prefix_trie(*with_shared_heads(turns, F.col("conv") - F.col("conv") % 20, heads))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE = {
    "op11_prefix_trie": """
WITH RECURSIVE
crc_step AS (
  SELECT i AS byte, i AS crc, 0 AS bit FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, bit + 1 FROM crc_step WHERE bit < 8),
crc_table AS (SELECT byte, crc FROM crc_step WHERE bit = 8),
ids AS (SELECT DISTINCT conv_id::BIGINT AS conv FROM conversations WHERE conv_id IS NOT NULL),
crcs AS (
  SELECT conv, 4294967295::BIGINT AS crc, 0 AS done FROM ids
  UNION ALL
  SELECT c.conv, xor(c.crc >> 8, t.crc), done + 1
  FROM crcs c JOIN crc_table t ON t.byte = xor(c.crc & 255, ord(substr(c.conv::VARCHAR, done + 1, 1)))
  WHERE done < length(c.conv::VARCHAR)),
convs AS (
  SELECT conv, conv - conv % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM crcs WHERE done = length(conv::VARCHAR)),
turns AS (
  SELECT conv_id::BIGINT AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT c.conv, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.conv AND t.pos >= c.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY part, pos) AS depth, sha256(length(role) || ':' || role || text) AS code FROM rebuilt),
lists AS (SELECT conv, list(code ORDER BY depth) AS codes FROM placed GROUP BY conv),
prefixes AS (
  SELECT p.conv, p.depth, sha256(array_to_string(l.codes[:p.depth], ',')) AS node,
    CASE WHEN p.depth = 1 THEN '' ELSE sha256(array_to_string(l.codes[:p.depth - 1], ',')) END AS parent,
    len(string_split_regex(trim(p.text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+'))
      - CASE WHEN trim(p.text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 1 ELSE 0 END AS words,
    p.depth = len(l.codes) AS is_end
  FROM placed p JOIN lists l USING (conv)
  UNION ALL
  SELECT c.conv, 0, '', NULL, 0, l.codes IS NULL FROM convs c LEFT JOIN lists l USING (conv)),
nodes AS (
  SELECT node, depth, parent, min(conv) AS conv, count(*) AS n, max(words) AS words,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (is_end), '')) AS ends
  FROM prefixes GROUP BY node, depth, parent),
kids AS (SELECT parent AS node, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
subtree AS (
  SELECT p.node, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (k.node IS NULL) AS leaves
  FROM nodes n JOIN prefixes p ON p.conv = n.conv AND p.depth <= n.depth LEFT JOIN kids k ON k.node = n.node
  GROUP BY p.node)
SELECT n.conv AS conv_id, n.depth::BIGINT AS depth, up.conv AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN subtree s ON s.node = n.node
"""
}
