"""Quality rules judged per host.

Counts of a text are taken inside the row. Failures are added up by host, the
failure rate of a host is shrunk towards the rate of all hosts with a beta prior
whose two parameters come from the hosts themselves (method of moments), and the
verdict on the host goes back to its documents. A host is bad if its shrunk rate is
more than two standard deviations of the prior above its mean: what counts as bad
follows from the hosts, and where their rates differ no more than chance makes them
differ, none is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import free_name, let, stored, table

MIN_WORDS, MAX_REPEAT_PCT, MAX_SYMBOL_PCT, BAD_DEVIATIONS = 50, 50, 10, 2.0
_NO_SPREAD = 1e-12  # a variance that is rounding
_POSITION_BITS = 28  # a string of 2 GB has fewer than 2**28 three-word windows apart


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Number of word positions inside windows that occur twice or more in the text.

    Sorting does the grouping: windows are sorted by a shortened hash packed with
    the position, neighbours that agree are sorted again by the whole hash.
    """
    low = F.lit((1 << _POSITION_BITS) - 1)

    def hashed(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
        )
        return let(F.when(F.size(w) >= width, grams).otherwise(F.array().cast("array<bigint>")), sorted_once)

    def sorted_once(grams: Column) -> Column:
        packed = F.sort_array(
            F.transform(grams, lambda h, i: F.shiftleft(h, _POSITION_BITS).bitwiseOR(i.cast("long")))
        )
        return let(packed, lambda s: candidates(s, grams))

    def candidates(s: Column, grams: Column) -> Column:
        def key(x: Column) -> Column:
            return F.shiftright(x, _POSITION_BITS)

        close = F.filter(
            s, lambda x, i: (key(x) == key(F.get(s, i - 1))) | (key(x) == key(F.get(s, i + 1)))
        )
        whole = F.sort_array(
            F.transform(
                close,
                lambda x: let(
                    x.bitwiseAND(low).cast("int"), lambda p: F.struct(F.get(grams, p).alias("h"), p.alias("p"))
                ),
            )
        )
        return let(whole, positions)

    def positions(t: Column) -> Column:
        same = F.filter(t, lambda x, i: (x["h"] == F.get(t, i - 1)["h"]) | (x["h"] == F.get(t, i + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, hashed)


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (null text: zeros)."""
    (w,) = free_name(df, "words")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words_of(t),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeated_words(ws).alias("n_repeat_words"),
        ),
    )
    return (
        df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        .withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn(w, counts)
        .withColumns({c: F.col(w)[c] for c in ("n_words", "word_chars", "n_repeat_words")})
        .drop(w)
    )


def rule_failures(df: DataFrame) -> DataFrame:
    """Add base_failed and symbols_failed from the counts."""
    return df.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")),
    ).withColumn("symbols_failed", 100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("n_words"))


def host_rates(failures: DataFrame, host: str, failed: str, deviations: float = BAD_DEVIATIONS) -> DataFrame:
    """Per host: n, n_failed, rate (shrunk by the empirical beta prior), bad.

    The prior has the mean m of the hosts' rates and their variance without what
    sampling adds to it, v = var(rate) - m (1 - m) avg(1 / n); it counts as
    m (1 - m) / v - 1 documents of rate m. If v is not above 0 every host gets the rate
    m; if it reaches m (1 - m), each keeps its own. A host is bad if its rate is above
    m + ``deviations`` * sqrt(v). Rows without a host take no part.
    """
    hosts = (
        failures.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count("*").alias("n"), F.count(F.when(F.col(failed), 1)).alias("n_failed"))
    )
    hosts = stored(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n")
    m, v, one_by_n = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n"))).first()
    if m is None:
        return hosts.withColumns({"rate": F.lit(None).cast("double"), "bad": F.lit(False)})
    v -= m * (1 - m) * one_by_n
    if v <= _NO_SPREAD:
        shrunk, bar = F.lit(m), m
    elif v >= m * (1 - m):
        shrunk, bar = rate, m + deviations * v**0.5
    else:
        strength = m * (1 - m) / v - 1
        shrunk, bar = (F.col("n_failed") + m * strength) / (F.col("n") + strength), m + deviations * v**0.5
    return hosts.withColumn("rate", shrunk.cast("double")).withColumn("bad", F.col("rate") > bar)


def host_verdicts(df: DataFrame, host: str = "source", text: str = "text", deviations: float = BAD_DEVIATIONS) -> DataFrame:
    """Add the counts, ``base_failed``, ``host_rate``, ``host_n``, ``host_failed`` and ``kept``; the text column goes.

    A document is kept if it passes the base rules and its host is not bad by its
    failures of the base and symbol rules, see ``host_rates``. Documents without a host
    are judged by the base rules alone; their ``host_rate`` and ``host_n`` are null. The
    join back to the hosts is on a narrow table; a host with a large share of the rows is
    split by the adaptive planner.
    """
    counted = stored(rule_failures(text_counts(df, text)).drop(text), "counts")
    (any_rule,) = free_name(counted, "any_rule")
    failures = counted.withColumn(any_rule, F.col("base_failed") | F.col("symbols_failed"))
    rates = host_rates(failures, host, any_rule, deviations)
    verdicts = rates.select(F.col(host), F.col("rate").alias("host_rate"), F.col("n").alias("host_n"), F.col("bad").alias("host_failed"))
    judged = counted.drop("host_rate", "host_n", "host_failed", "kept").join(verdicts, host, "left")
    failed = F.coalesce("host_failed", F.lit(False))
    return judged.withColumn("host_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op2_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return host_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.round("host_rate", 9).alias("host_rate"), "host_n", "host_failed", "kept",
    )


_SQL = f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
lists AS (
  SELECT doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM texts
),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM lists),
grams AS (
  SELECT doc_id, pos, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
twice AS (
  SELECT doc_id, pos FROM grams WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
),
hit AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
),
counts AS (
  SELECT l.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
  FROM lists l LEFT JOIN hit ON hit.doc_id = l.doc_id
),
ruled AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
         100 * n_symbols > {MAX_SYMBOL_PCT} * n_words AS symbols_failed
  FROM counts
),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR symbols_failed) AS f
  FROM ruled WHERE source IS NOT NULL GROUP BY source
),
moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS raw, avg(1.0::DOUBLE / n) AS r FROM hosts),
prior AS (SELECT m, raw - m * (1 - m) * r AS v FROM moments),
rates AS (
  SELECT source, n, m, v, CASE WHEN v <= {_NO_SPREAD} THEN m WHEN v >= m * (1 - m) THEN f / n
    ELSE (f + m * (m * (1 - m) / v - 1)) / (n + m * (1 - m) / v - 1) END AS rate
  FROM hosts, prior
),
verdicts AS (SELECT *, v > {_NO_SPREAD} AND rate > m + {BAD_DEVIATIONS} * sqrt(v) AS bad FROM rates)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(rate, 9) AS host_rate, n AS host_n, coalesce(bad, false) AS host_failed,
       NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM ruled r LEFT JOIN verdicts ON verdicts.source = r.source
"""

QUERIES = {"op2_host_rules": op2_host_rules}
ORACLE = {"op2_host_rules": _SQL}
