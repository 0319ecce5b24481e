"""Toxic texts by a support vector machine on a subsequence kernel.

The kernel of two words is the number of common subsequences of four letters, each
weighted by ``DECAY`` for every place it spans, up to ``SPAN`` places: letters that
were put between those of an insult, or left out, cost weight but keep the match.
Nyström landmarks turn words into vectors, and a linear machine separates words of
toxic sentences from words of clean ones. Its decision is a sum over subsequences,
so the landmarks fold into one weight per subsequence and a text is scored by
gathers from that table, in time linear in the text.

The label of a text tells about its sentences what it can: every word of a clean
text is clean, and a toxic text has at least one toxic word. Words that are much too
frequent in toxic texts to be there by chance start as toxic; clean words that the
machine gets wrong are added as examples and it is trained again. A text
is judged by its three worst words, in whichever sentences they are, and by its
length; a logistic curve fitted to the training texts makes this a probability.
"""

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sievecraft.llm.common import bounded_batches, release_memory, stored, table
from sievecraft.llm.shingles import text_batches

DECAY, SPAN, LOWEST, THRESHOLD = 0.75, 6, -4.0, 0.3
#: Bounds of the training sample: texts of a class, words, landmarks of a class.
MAX_TOXIC, MAX_CLEAN, MAX_WORDS, FIRST_WORDS, LANDMARKS = 4000, 12000, 40_000, 4000, 128

# 0 stands between words, 1 to 26 are letters (some digits stand for letters), 27 to 31 are
# classes of other characters, 255 is left out
_CODE = np.full(256, 255, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _CODE[_b] = ord(chr(_b).lower()) - 96
    elif 0x80 <= _b < 0xC0:
        _CODE[_b] = 27 + _b % 5
for _digit, _letter in zip("01345", "oieas"):
    _CODE[ord(_digit)] = ord(_letter) - 96
for _b in b"\x00 \t\n\x0b\x0c\r":
    _CODE[_b] = 0
_GAPS = [g for g in itertools.combinations(range(1, SPAN), 3)]


def letters(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts with one 0 before, between and after words; text of each word.

    Words of one letter that follow each other are one word, as in a spelt-out insult.
    """
    joined = b"\x00" + b"\x00".join((t or b"").replace(b"\x00", b" ") for t in texts) + b"\x00"
    data = np.frombuffer(joined, np.uint8)
    code = _CODE[data]
    text = np.cumsum(data == 0, dtype=np.int32) - 1
    keep = code != 255
    code, text = code[keep], text[keep]
    again = np.zeros(len(code), np.bool_)
    again[1:] = (code[1:] == 0) & (code[:-1] == 0)
    code, text = code[~again], text[~again]
    bounds = np.flatnonzero(code == 0)
    size = np.diff(bounds) - 1
    spelt = np.zeros(len(bounds), np.bool_)
    spelt[1:-1] = (size[:-1] == 1) & (size[1:] == 1) & (text[bounds[:-2] + 1] == text[bounds[1:-1] + 1])
    keep = np.ones(len(code), np.bool_)
    keep[bounds[spelt]] = False
    code, text = code[keep], text[keep]
    bounds = np.flatnonzero(code == 0)
    return code, text[np.minimum(bounds[:-1] + 1, len(text) - 1)]


def subsequences(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Places, subsequence numbers and weight, for each choice of gaps, within words."""
    n = len(code)
    bounds = np.flatnonzero(code == 0)
    size = np.diff(bounds)  # from each 0 to the next
    room = np.zeros(n, np.int32)  # places up to the next 0
    room[: bounds[-1]] = np.repeat(bounds[1:], size) - np.arange(bounds[-1])
    wide = code.astype(np.int32)
    for a, b, c in _GAPS:
        if c >= n:
            continue
        fits = np.flatnonzero(room[: n - c] >= c)
        number = (wide[fits] << 15) + (wide[fits + a] << 10) + (wide[fits + b] << 5) + wide[fits + c]
        yield fits, number, DECAY ** (c + 1)


def word_scores(code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of subsequence weights of each word."""
    total = np.zeros(len(code), np.float32)
    for places, number, weight in subsequences(code):
        total[places] += weights[number] * np.float32(weight)
    return np.add.reduceat(total, np.flatnonzero(code == 0)[:-1])


@dataclass
class Model:
    """Weights of subsequences, the bias of a word, and the logistic curve of a text."""

    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def decisions(self, texts: list[bytes | None]) -> np.ndarray:
        """Per text: the three highest word decisions and the logarithm of the number of words; NaN without words."""
        out = np.full((len(texts), 4), np.nan)
        code, text = letters(texts)
        if not len(text):
            return out
        scores = word_scores(code, self.weights) + np.float32(self.bias)
        has = np.diff(np.flatnonzero(code == 0)) > 1
        scores, text = scores[has], text[has]
        if not len(text):
            return out
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        size = np.diff(np.append(first, len(text)))
        rows = text[first]
        for k in range(3):
            best = np.maximum.reduceat(scores, first)
            out[rows, k] = np.maximum(best, LOWEST)
            at = np.flatnonzero(scores == np.repeat(best, size))
            at = at[np.concatenate(([True], text[at[1:]] != text[at[:-1]]))]  # one word of each text
            scores[at] = LOWEST
        out[rows, 3] = np.log(size)
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        found = self.decisions(texts)
        odds = np.nan_to_num(found, nan=0.0) @ self.slopes + self.offset
        return np.where(np.isnan(found[:, 0]), 0.0, 1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def _features(words: list[str], columns: dict[int, int] | None) -> tuple[np.ndarray, dict[int, int]]:
    """Dense weights of the known subsequences (all, if None) for each word."""
    code, _ = letters([w.encode() for w in words])
    owner = np.cumsum(code == 0) - 1
    rows, numbers, values = [], [], []
    for places, number, weight in subsequences(code):
        rows.append(owner[places])
        numbers.append(number)
        values.append(np.full(len(places), weight, np.float32))
    rows, numbers, values = (np.concatenate(x) for x in (rows, numbers, values))
    if columns is None:
        columns = {int(u): i for i, u in enumerate(np.unique(numbers))}
    known = np.array(sorted(columns), np.int64)
    at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    hit = known[at] == numbers
    out = np.zeros((len(words), len(known)), np.float32)
    np.add.at(out, (rows[hit], at[hit]), values[hit])
    return out, columns


def _machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps."""
    z = np.hstack([z, np.ones((len(z), 1), z.dtype)])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w, active = np.zeros(z.shape[1]), np.ones(len(z), np.bool_)
    for _ in range(50):
        part = z[active] * cost[active, None].astype(z.dtype)
        w = np.linalg.solve(ridge + part.T @ z[active], part.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def train_words(toxic: list[str], clean: list[str], rounds: int = 3) -> tuple[np.ndarray, float]:
    """Weights of all subsequences and the bias, from toxic and clean words in random order."""
    marks = toxic[:LANDMARKS] + clean[:LANDMARKS]
    basis, columns = _features(marks, None)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])  # landmarks -> orthonormal directions
    project = (half.T @ basis).T.astype(np.float32)

    def vectors_of(words: list[str]) -> np.ndarray:
        return np.concatenate([_features(words[i : i + 1000], columns)[0] @ project for i in range(0, len(words), 1000)])

    places, code = np.array(sorted(columns), np.int64), letters([w.encode() for w in clean])[0]
    up, down, tried = vectors_of(toxic), vectors_of(clean[:FIRST_WORDS]), np.arange(min(FIRST_WORDS, len(clean)))
    for _ in range(rounds):
        z, y = np.vstack([up, down]), np.repeat([1.0, -1.0], [len(up), len(down)])
        w = _machine(z, y, np.repeat([max(10.0, len(down) / len(up)), 10.0], [len(up), len(down)]))
        table_ = np.zeros(1 << 20, np.float32)
        table_[places] = project @ w[:-1]
        wrong = np.setdiff1d(np.flatnonzero(word_scores(code, table_) + w[-1] > -1), tried)[:FIRST_WORDS]
        if not len(wrong):
            break
        down, tried = np.vstack([down, vectors_of([clean[i] for i in wrong])]), np.append(tried, wrong)
    return table_, float(w[-1])


def _curve(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the logistic curve, with the usual smoothed targets, by Newton steps."""
    up, down = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.01] * (x.shape[1] - 1) + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge, x.T @ (target - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def least_count(totals: dict[int, int], toxic_texts: int, clean_texts: int) -> int:
    """From how many texts on a word of toxic texts alone is not there by chance.

    ``totals`` has the number of words by number of texts. If labels were dealt at
    random, a word of k texts would fall into toxic ones only with probability
    share**k. The least k is taken for which less than half a word would do so.
    """
    share = toxic_texts / (toxic_texts + clean_texts)
    k, above = 2, sum(n for t, n in totals.items() if t >= 2)
    while above * share**k >= 0.5:
        above -= totals.get(k, 0)
        k += 1
    return k


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model from labelled texts.

    At most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean texts are used, those with the
    smallest hash of their id, and at most ``MAX_WORDS`` of their clean words, by hash.
    Rows without text, id or label are left out; of labels that disagree on an id the
    larger counts. Without toxic or without clean texts, or without words that tell
    them apart, every text scores 0.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(doc_id).agg(F.max(toxic).alias("y"))
    chosen = None
    for y, limit in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = stored(chosen.withColumn("y", F.col("y").cast("int")), "chosen")  # rows made from a list would start Python workers
    none = Model(np.zeros(1 << 20, np.float32), 0.0, np.zeros(4), -40.0)
    if picked.select("y").distinct().count() < 2:
        return none
    sample = docs.select(doc_id, text).where(F.col(text).isNotNull()).join(F.broadcast(picked), doc_id)
    sample = stored(sample.select(F.col(text).alias("text"), "y"), "labelled")
    # words in the sense of ``letters`` that matter for the list: runs without white space, letters only
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\s]", ""), r"\s+"))
    counted = (
        sample.select(F.explode(words).alias("w"), "y")
        .where("length(w) BETWEEN 3 AND 40")
        .groupBy("w")
        .agg(F.sum("y").alias("a"), F.count(F.when(F.col("y") == 0, 1)).alias("b"))
    )
    counted = stored(counted, "word_counts")
    texts = dict(sample.groupBy("y").count().collect())
    totals = dict(counted.groupBy(F.col("a") + F.col("b")).count().collect())
    least = least_count(totals, texts.get(1, 0), texts.get(0, 1))
    frequent = counted.where((F.col("b") == 0) & (F.col("a") >= least)).orderBy(F.desc("a"), F.xxhash64("w"))
    up = [r.w for r in frequent.select("w").limit(MAX_WORDS).collect()]
    down = [r.w for r in counted.where("b > 0").orderBy(F.xxhash64("w")).select("w").limit(MAX_WORDS).collect()]
    if not up or not down:
        return none
    weights, bias = train_words(up, down)
    model = Model(weights, bias, np.zeros(4), 0.0)
    # a filter on x would be pushed below it and run the function twice in each task, in two Python workers
    rows = sample.select(_applied("array<double>", F.col("text"), model).alias("x"), "y").collect()
    rows = [r for r in rows if not np.isnan(r.x[0])]
    model.slopes, model.offset = _curve(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))
    return model


def _applied(kind: str, text: Column, model: Model) -> Column:
    held = SparkSession.getActiveSession().sparkContext.broadcast(model)  # 4 MB, whatever the corpus

    @arrow_udf(kind)
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw = texts.cast(pa.binary()).to_pylist()
            parts = [raw[a:b] for a, b in text_batches(raw)]
            if kind == "double":
                yield pa.array(np.concatenate([held.value.score(p) for p in parts] or [np.zeros(0)]), pa.float64())
            else:
                yield pa.array([row for p in parts for row in held.value.decisions(p).tolist()], pa.list_(pa.float64()))
        release_memory()

    return decide(text)


def toxicity(text: Column, model: Model) -> Column:
    """Probability that a text is toxic; 0 for null, empty and wordless texts."""
    return _applied("double", text, model)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train_on_tables(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the registered query: labels of every fourth id, by CRC-32, are never read."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~is_held_out(F.col("doc_id")))
    with bounded_batches(spark):
        return train(docs.select("doc_id", "text"), labels)


def op5_subsequence_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_on_tables(spark, docs, sf_dir)
    with bounded_batches(spark):
        scored = stored(docs.select("doc_id", toxicity(F.col("text"), model).alias("score")), "scores")
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op5_subsequence_toxicity": op5_subsequence_toxicity}
ORACLE: dict[str, str] = {}
