import hashlib
import random

from pyspark.sql import functions as F

from sievecraft.functions.text import (
    WHITESPACE,
    est_tokens,
    is_blank,
    ngram_fingerprint,
    normalize,
    strip,
    strip_key,
)


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def gram_set(text, n):
    """What a fingerprint stands for: the set of word n-grams, or all words of a shorter text."""
    w = text.lower().split()
    return frozenset(zip(*(w[k:] for k in range(n)))) or tuple(w)


def random_texts(count, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "B", "é", "Σ", "漢", "𝒳", "x1", "-"]
    texts = ["", " \t", "one", "a b c d", "a b c d e", "A  b\tC d"]
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 2))))
            parts.append("".join(rng.choice(WHITESPACE) for _ in range(rng.randint(1, 3))))
        texts.append(rng.choice(["", " ", "　"]) + "".join(parts))
    return texts


def test_whitespace_is_pythons():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_text_expressions_equal_python(spark):
    texts = random_texts(400)
    c = F.col("t")
    rows = (
        spark.createDataFrame([(t,) for t in texts], "t string")
        .select(
            c, strip(c).alias("s"), is_blank(c).alias("b"), normalize(c).alias("n"),
            strip_key(c).alias("k"), est_tokens(c).alias("e"), ngram_fingerprint(c).alias("f"),
            ngram_fingerprint(c, 2).alias("f2"),
        )
        .collect()
    )
    for r in rows:
        assert r.s == r.t.strip()
        assert r.b == (r.t.strip() == "")
        assert r.n == " ".join(r.t.lower().split())
        assert r.k == md5(r.t.strip())
        assert r.e == len(r.t) // 4
    for n, of in ((5, lambda r: r.f), (2, lambda r: r.f2)):
        for a, b in zip(rows, sorted(rows, key=of)):
            assert (of(a) == of(b)) == (gram_set(a.t, n) == gram_set(b.t, n))
        assert len({of(r) for r in rows}) == len({gram_set(r.t, n) for r in rows})


def test_fingerprint_golden(spark):
    cases = {
        "one": "one",
        "A b\tC d": "a b c d",
        "a b c d e": "a b c d e",
        "b c d e f a": "b c d e f\nc d e f a",
        "x x x x x x x": "x x x x x",
        "e d c b a z": "d c b a z\ne d c b a",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", ngram_fingerprint(F.col("t")).alias("f"))
    assert {r.t: r.f for r in df.collect()} == {t: md5(k) for t, k in cases.items()}


def test_same_ngram_set_same_fingerprint(spark):
    a, b = " ".join(["a b"] * 5), " ".join(["b a"] * 5 + ["b"])
    texts = [(a,), (b,), ("w x y z",), ("W  x\ty Z ",), ("",), (" \n",)]
    keys = [r[0] for r in spark.createDataFrame(texts, "t string").select(ngram_fingerprint(F.col("t"))).collect()]
    assert keys[0] == keys[1]
    assert keys[2] == keys[3]
    assert keys[4] == keys[5] == md5("")
