"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Items and texts are lower-cased (A-Z) and cut into words; every run of
``window`` item words (a shorter item: all its words) is a pattern. A text is
normalised to words joined by one space and scanned once, whatever the number of
patterns. Byte positions of the words lead back to offsets in the original.

Benchmarks above ``block_bytes`` are dealt into blocks by item hash, and the texts
pass one automaton per block, one after the other in the same row: neither side is
shuffled. A block is what the driver and a Python worker hold at a time.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sievecraft.llm.common import free_name, stored, table

WINDOW, MIN_PERCENT, BLOCK_BYTES = 13, 5, 16 << 20

# bytes that are no word bytes become a space, A-Z become a-z
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)

_SCAN_TYPE = "n_words long, hits array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


def item_windows(texts: list[str | None], window: int) -> dict[bytes, tuple[int, list[int]]]:
    """Pattern (words with a space on each side) -> number of words, places of its items."""
    found: dict[bytes, tuple[int, list[int]]] = {}
    for place, text in enumerate(texts):
        words = (text or "").encode().translate(_FOLD).split()
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            pattern = b" " + b" ".join(words[i : i + size]) + b" "
            places = found.setdefault(pattern, (size, []))[1]
            if not places or places[-1] != place:
                places.append(place)
    return found


def _scanner(items, window: int):
    """Iterator over Arrow string arrays -> struct arrays; the automaton is built once per task."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        names, texts_of_items = items.value
        automaton = ahocorasick.Automaton()
        for pattern, value in item_windows(texts_of_items, window).items():
            automaton.add_word(pattern.decode("latin-1"), value)
        if len(automaton):
            automaton.make_automaton()
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("hits", pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")]))),
                ("items", pa.list_(pa.string())),
            ]
        )

        def one(raw: bytes | None) -> dict:
            folded = (raw or b"").translate(_FOLD)
            words = folded.split()
            out = {"n_words": len(words), "hits": [], "items": []}
            if not words or not len(automaton):
                return out
            line = b" " + b" ".join(words) + b" "
            spans, items, gaps = [], set(), None
            for end, (size, places) in automaton.iter(line.decode("latin-1")):
                if gaps is None:
                    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                last = int(np.searchsorted(gaps, end)) - 1
                first = last - size + 1
                items.update(places)
                while spans and first <= spans[-1][1] + 1:  # ends come in order, so only starts reach back
                    first = min(first, spans.pop()[0])
                spans.append((first, last))
            if spans:
                data = np.frombuffer(folded, np.uint8)
                inside = np.concatenate(([False], data != 32, [False]))
                edges = np.flatnonzero(inside[1:] != inside[:-1])
                chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                for first, last in spans:
                    start, end = int(edges[2 * first]), int(edges[2 * last + 1])
                    out["hits"].append(
                        {"first": first, "last": last, "start": int(chars[start]) - 1, "end": int(chars[end - 1])}
                    )
                out["items"] = [names[p] for p in sorted(items)]
            return out

        for texts in batches:
            yield pa.array([one(x) for x in texts.cast(pa.binary()).to_pylist()], kind)

    return scan


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_percent: int = MIN_PERCENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add n_words, n_hit, item_ids (as strings, sorted), hit_spans and contaminated.

    ``hit_spans`` are code-point offsets [start, end) in the original text, merged.
    A text is contaminated if a word of it is hit and hit words make up at least
    ``min_percent`` of its words. Null or empty texts have no words and are clean;
    null or wordless items have no windows; an item that occurs twice under one id
    counts once. The words of an item without an id are hit like others, but it is not
    among the ``item_ids``. An empty benchmark leaves every document clean. Result columns
    that exist already are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "item_ids", "hit_spans", "contaminated")
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length(item_text), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    hit, ids, spans = free_name(docs, "hit", "ids", "spans")
    out = docs
    items = benchmark.select(
        F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")
    ).where("t IS NOT NULL")
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = part.collect()  # at most about block_bytes
        held = spark.sparkContext.broadcast(([r.i for r in rows], [r.t for r in rows]))
        scan = arrow_udf(_scanner(held, window), _SCAN_TYPE)
        out = out.withColumn(hit, scan(F.col(text)))
        if b:
            out = out.withColumns({spans: F.concat(spans, f"{hit}.hits"), ids: F.concat(ids, f"{hit}.items")})
        else:
            out = out.withColumns({c: F.col(hit)[f] for c, f in (("n_words", "n_words"), (spans, "hits"), (ids, "items"))})
        out = out.drop(hit)
        if b % 16 == 15:  # keep the plan short
            out = stored(out, "scanned")
    if blocks > 1:
        out = out.withColumn(spans, F.sort_array(spans))
    merged = F.aggregate(
        spans,
        F.struct(F.lit(-1).alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["reach"], s["last"]).alias("reach"),
            (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["reach"], s["first"] - 1))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return (
        out.withColumn("n_hit", merged)
        .withColumn("item_ids", F.sort_array(F.array_distinct(F.array_compact(ids))))
        .withColumn("hit_spans", F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")))
        .drop(ids, spans)
    )


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_SQL = f"""
WITH items AS (
  SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
  WHERE len(w) > 0
),
patterns AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM items)
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs),
grams AS (
  SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM starts, (SELECT DISTINCT k FROM patterns) AS ks WHERE p + k - 1 <= len(w)
),
hits AS (SELECT doc_id, p, g.k, item_id FROM grams g JOIN patterns t ON t.k = g.k AND t.gram = g.gram),
words_hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS spot FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id
),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN words_hit h ON h.doc_id = d.doc_id LEFT JOIN items_hit i ON i.doc_id = d.doc_id"""

QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLE = {"op9_benchmark_decontamination": _SQL}
