"""Label sequences: one array of token ids per sample, prompt positions marked.

A sample is one row, so everything here stays inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import let

# Fixed values.
IGNORE_INDEX = -100
MIN_SUFFIX_TOKENS = 16


def response_ids(labels: Column) -> Column:
    """Token ids at response positions, in order."""
    return F.filter(labels, lambda x: x != IGNORE_INDEX)


def response_positions(labels: Column) -> Column:
    """Sequence positions of the response tokens, ascending."""
    marked = F.transform(labels, lambda x, i: F.when(x != IGNORE_INDEX, i))
    return F.filter(marked, lambda p: p.isNotNull())


def suffix_ids(labels: Column, pos: Column, k: int) -> Column:
    """Response tokens among the ``k`` sequence positions after ``pos``.

    Looked up one by one: ``slice`` would copy the whole sequence each time.
    """
    offsets = F.sequence(F.lit(1), F.lit(k))
    return response_ids(F.transform(offsets, lambda o: F.get(labels, pos + o)))


def suffix_usable(labels: Column, positions: Column, pos: Column, rank: Column, k: int, min_len: int, visible: Column | None) -> Column:
    """The window after ``pos`` is long enough and decodes to visible text.

    ``pos`` is element ``rank`` of the response ``positions``, so the window holds
    ``min_len`` tokens when the element that many places on still lies in it.
    ``visible`` tells of each position of the row whether its token shows; without it
    every response token does.
    """
    long_enough = F.coalesce(F.get(positions, rank + min_len) <= pos + k, F.lit(False))

    def shows(o: Column) -> Column:
        return F.get(labels, pos + o) != IGNORE_INDEX if visible is None else F.get(visible, pos + o)

    # Stops at the first visible token.
    return long_enough & F.coalesce(F.exists(F.sequence(F.lit(1), F.lit(k)), shows), F.lit(False))


def anchor_positions(labels: Column, k: int, stride: int, min_len: int, visible: Column | None = None) -> Column:
    """Every ``stride``-th response position, if the window after it is usable."""

    def chosen(ps: Column) -> Column:
        def keep(p: Column, rank: Column) -> Column:
            return (rank % stride == 0) & suffix_usable(labels, ps, p, rank, k, min_len, visible)

        return F.filter(ps, keep)

    return let(response_positions(labels), chosen)


def anchor_suffixes(labels: Column, k: int, stride: int, min_len: int, visible: Column | None = None) -> Column:
    """Array of (pos, suffix) of the anchors."""
    return F.transform(
        anchor_positions(labels, k, stride, min_len, visible),
        lambda p: F.struct(p.alias("pos"), suffix_ids(labels, p, k).alias("suffix")),
    )


def window_key(suffix: Column) -> Column:
    """128 bits that tell windows of token ids apart, wherever they lie."""
    return F.unhex(F.md5(F.array_join(suffix, ",")))


def _stretch_ends(labels: Column, anchors: Column, pos: Column, i: Column) -> tuple[Column, Column]:
    """First and last position of the row that anchor ``i``, at ``pos``, is nearest to."""
    left = F.when(i == 0, F.lit(0)).otherwise(F.floor((F.get(anchors, i - 1) + pos) / 2).cast("int") + 1)
    right = F.when(i == F.size(anchors) - 1, F.size(labels) - 1).otherwise(F.floor((pos + F.get(anchors, i + 1)) / 2).cast("int"))
    return left, right


def anchor_loads(labels: Column, anchors: Column) -> Column:
    """Array of (src_pos, n): how many response positions each anchor is nearest to.

    The run-length form of ``nearest_anchors``: a number per stretch where that has a
    row per position.
    """

    def load(a: Column) -> Column:
        def of(pos: Column, i: Column) -> Column:
            inside = F.filter(F.sequence(*_stretch_ends(labels, a, pos, i)), lambda p: F.get(labels, p) != IGNORE_INDEX)
            return F.struct(pos.alias("src_pos"), F.size(inside).cast("long").alias("n"))

        return F.transform(a, of)

    return let(anchors, load)


def nearest_anchors(labels: Column, anchors: Column) -> Column:
    """Array of (pos, src_pos): the closest anchor of each response position.

    Distance counts sequence positions, ties go to the earlier anchor. Each
    anchor owns the stretch up to the midpoints to its neighbours, so the work is
    linear in the sequence. Without anchors every ``src_pos`` is null.
    """

    def owned(a: Column) -> Column:
        def stretch(pos: Column, i: Column) -> Column:
            inside = F.filter(F.sequence(*_stretch_ends(labels, a, pos, i)), lambda p: F.get(labels, p) != IGNORE_INDEX)
            return F.transform(inside, lambda p: F.struct(p.alias("pos"), pos.alias("src_pos")))

        return F.flatten(F.transform(a, stretch))

    none = F.transform(
        response_positions(labels),
        lambda p: F.struct(p.alias("pos"), F.lit(None).cast("int").alias("src_pos")),
    )
    return let(anchors, lambda a: F.when(F.size(a) > 0, owned(a)).otherwise(none))


def own_targets(labels: Column, k: int, min_len: int, visible: Column | None = None) -> Column:
    """Array of (pos, src_pos) for stride 1: each position is its own source, or has none."""

    def source(ps: Column) -> Column:
        def own(p: Column, rank: Column) -> Column:
            usable = suffix_usable(labels, ps, p, rank, k, min_len, visible)
            return F.struct(p.alias("pos"), F.when(usable, p).alias("src_pos"))

        return F.transform(ps, own)

    return let(response_positions(labels), source)


def position_weights(labels: Column) -> Column:
    """Array of (pos, rank, weight): 1-based rank in the response, share still to come."""

    def weigh(ps: Column) -> Column:
        n = F.size(ps)
        return F.transform(
            ps,
            lambda p, i: F.struct(
                p.alias("pos"),
                (i + 1).alias("rank"),
                ((n - i) / n).alias("weight"),
            ),
        )

    return let(response_positions(labels), weigh)
