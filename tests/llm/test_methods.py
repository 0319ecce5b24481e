"""The methods against brute force, the libraries, exact round trips and held-out labels."""

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as registry
from sievecraft.llm import bpe, compact_windows, dart_minhash, pseudonyms, sharding, shingles, token_files, toxicity

SF = "/root/testdata/sf0.01"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]]


def _grams(text, width=5):
    w = text.encode().translate(shingles.FOLD).split()
    return collections.Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else None


# ---- BPE -------------------------------------------------------------------


@pytest.fixture(scope="module", params=["word_bpe_49k.json"])
def pair(request):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path(request.param)
    return bpe.Tokenizer(path), Tokenizer.from_file(path)


PIECES = ["a", "b", "'", "s", "re", "é", "́", " ", "1", "<|endoftext|>", "!", "Σ", "😀", "th", "ing", "　", "ß", "\x1c"]


@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_streamed_encoding_is_the_librarys(pair, data):
    own, library = pair
    text = "".join(data.draw(st.lists(st.sampled_from(PIECES), max_size=400)))
    step = data.draw(st.sampled_from([7, 97, 5000]))
    stream, out = bpe.TextStream(own), []
    for at in range(0, len(text), step):
        out.extend(stream.feed(text[at : at + step]))
    out.extend(stream.finish())
    ids = np.frombuffer(b"".join(out), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.decode_ids(own, np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_words_without_end_are_encoded_in_constant_memory(pair):
    own, library = pair
    rng = random.Random(3)
    for letters in (["a", "b", "c", "in", "th"], ["日", "本", "é"], ["!", "?"]):
        text = "".join(rng.choice(letters) for _ in range(20000))
        stream, held, out = bpe.WordStream(own.merges), 0, []
        symbols = own.words.symbols(text.lower())
        for at in range(0, len(symbols), 100):
            out.extend(stream.feed(symbols[at : at + 100]))
            held = max(held, len(stream.held))
        out.extend(stream.finish())
        assert out == library.encode(text, add_special_tokens=False).ids
        assert held < 8 * (own.merges.lookahead + own.merges.longest)


def test_lookahead_bound_holds(pair):
    """What stands more than the bound behind a token doesn't change it."""
    merges, rng = pair[0].merges, random.Random(5)
    short = [t for t in merges.ids if len(t) <= 3 and ord(t[-1]) < 0x100000 and t.isalpha()]
    for _ in range(200):
        head = "".join(rng.choice(short) for _ in range(40))
        tail = [head + "".join(rng.choice(short) for _ in range(400)) for _ in range(2)]
        cuts = [merges.search(t) for t in tail]
        ends = [list(np.cumsum([len(x) for x in c])) for c in cuts]
        common = [e for e in ends[0] if e <= len(head) - merges.lookahead]
        assert common == [e for e in ends[1] if e <= len(head) - merges.lookahead]


def test_bytes_decoder_waits_for_whole_characters(pair):
    class Bytes:
        tokens = {i: c for c, i in zip(bpe.byte_characters().values(), bpe.byte_characters())}
        byte_of = {c: b for b, c in bpe.byte_characters().items()}
        byte_level_decoder = True

    stream = bpe.DecodeStream(Bytes())
    out = [stream.feed([b]) for b in "aé😀".encode() + b"\xff\xe2\x82"]
    assert out == ["a", "", "é", "", "", "", "😀", "�", "", ""] and stream.finish() == "�"


def test_op6(spark, texts, pair):
    got = QUERIES["op6_streaming_bpe"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(texts.doc_id, texts.text):
        ids = pair[1].encode(t, add_special_tokens=False).ids
        row = got.loc[i]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---- near-duplicates -------------------------------------------------------


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8):
        n = 800
        k = int(2 * n * share / (1 + share))
        a = rng.integers(1, 1 << 60, n).astype(np.uint64)
        b = np.concatenate((a[:k], rng.integers(1, 1 << 60, n - k).astype(np.uint64)))
        x, y = rng.uniform(0.2, 5, n), rng.uniform(0.2, 5, n)
        both = np.minimum(x[:k], y[:k]).sum()
        sig, has = dart_minhash.signatures(np.repeat([0, 1], n), np.concatenate((a, b)), np.concatenate((x, y)), 3, 4000)
        assert has.tolist() == [True, True, False]
        assert abs((sig[0] == sig[1]).mean() - both / (x.sum() + y.sum() - both)) < 0.03


def test_classes_are_those_of_all_pairs(spark, texts):
    got = QUERIES["op4_dart_minhash"](spark, SF).toPandas().set_index("doc_id").class_id.to_dict()
    grams = {i: _grams(t) for i, t in zip(texts.doc_id, texts.text)}
    where, parent = collections.defaultdict(list), {i: i for i in grams}
    for i, c in grams.items():
        for g in c or ():
            where[g].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for l in where.values() for a in l for b in l if a < b}:
        both = sum((grams[a] & grams[b]).values())
        if both >= 0.8 * (sum(grams[a].values()) + sum(grams[b].values()) - both) - 1e-9:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in grams}


def test_links_apart_from_the_centre_are_found(spark):
    """Copies that differ too much from the hub of their bucket, but are alike among each other."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    rows, want = [], {}
    for i in range(40):
        t = list(base)
        t[7 * i + 3] = word()
        rows.append((i, " ".join(t)))
    for k in range(3):  # families that lack different parts of the base and have their own
        own = base[: 40 * k] + [word() for _ in range(40)] + base[40 * k + 40 :]
        for j in range(4):
            t = list(own)
            t[290 - j * 10] = word()
            rows.append((100 + 10 * k + j, " ".join(t)))
            want[100 + 10 * k + j] = 100 + 10 * k
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = {i: _grams(t) for i, t in rows}
    for i, c in want.items():
        both = sum((grams[i] & grams[c]).values())
        assert both / (2 * 296 - both) >= 0.8 and got[i] == got[c]
    assert {got[i] for i in range(40)} == {0}


def test_links_between_members_far_from_their_centre_are_found(spark):
    """Two alike texts in one bucket with a third that has half of them, whichever is the centre."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(60):
        base = [word() for _ in range(200)]
        other = [*base[:190], *(word() for _ in range(10))]
        rows += [(3 * k + i, " ".join(t)) for i, t in enumerate((base, other, base[:100] + [word() for _ in range(100)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs, bands=1, rows=1).collect()}
    signed = dart_minhash.sign(docs.selectExpr("doc_id AS doc", "unhex(md5(CAST(text AS BINARY))) AS content", "text"), 5, 1, 1)
    bucket = {r.doc: r.bands[0] for r in signed.collect()}
    same = [i for i in range(0, 180, 3) if bucket[i] == bucket[i + 1]]
    assert sum(bucket[i] == bucket[i + 2] for i in same) > 9
    assert all(got[i] == got[i + 1] == i and got[i + 2] == i + 2 for i in same)


# ---- passages --------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(values=st.lists(st.integers(0, 30), max_size=120), length=st.integers(1, 12))
def test_compact_windows_are_nodes_of_the_tree(values, length):
    v, want = np.array(values, np.uint64), []
    for c in range(len(values)):
        left, right = c, c
        while left > 0 and values[left - 1] > values[c]:
            left -= 1
        while right + 1 < len(values) and values[right + 1] >= values[c]:
            right += 1
        if right - left + 1 >= length:
            want.append((left, c, right))
    assert sorted(compact_windows.compact_windows(v, length)) == sorted(want)


def test_op7_finds_all_exact_passages(spark, texts):
    got = QUERIES["op7_compact_windows"](spark, SF).toPandas()
    words = {i: t.encode().translate(shingles.FOLD).split() for i, t in zip(texts.doc_id, texts.text)}
    where = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    assert {i for l in where.values() if len(l) > 1 for i in l} <= set(got.doc_id)
    for r in got.itertuples():
        a, b = words[r.doc_id][r.start : r.end], words[r.other_id][r.other_start : r.other_end]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and r.doc_id != r.other_id and len(x & y) / len(x | y) > 0.75


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def test_op7_finds_edited_passages(spark):
    """A word replaced, put in or left out at every place of a passage of 50 words."""
    rng = random.Random(5)
    rows, edited = [], []
    for place in range(1, 49):
        for kind in range(3):
            base, n = _words(rng, 51 if kind == 2 else 50), len(rows)
            new = base[:place] + [_words(rng, 1), [base[place], *_words(rng, 1)], []][kind] + base[place + 1 :]
            rows += [(n + i, " ".join(_words(rng, 30 + i) + w + _words(rng, 20))) for i, w in enumerate((base, new))]
            a, b = (set(zip(*(w[k:] for k in range(5)))) for w in (base, new))
            if len(a & b) >= 0.8 * len(a | b):
                edited.append(n + 1)
    got = {r.doc_id for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(edited) > 120 and {x - i for x in edited for i in (0, 1)} <= got


def test_op7_finds_passages_whose_parts_are_swapped(spark):
    """Every cut of a passage that leaves it similar enough; no chain of one diagonal has it."""
    rng = random.Random(7)
    rows, swapped = [], []
    for size in (50, 60, 76, 90):
        for cut in range(5, size - 4, 3):
            base, n = _words(rng, size), len(rows)
            new = base[cut:] + base[:cut]
            rows += [(n + i, " ".join(_words(rng, 30 + i) + w + _words(rng, 20))) for i, w in enumerate((base, new))]
            a, b = (set(zip(*(w[k:] for k in range(5)))) for w in (base, new))
            if len(a & b) >= 0.8 * len(a | b):
                swapped.append(n + 1)
    got = {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(swapped) > 70 and {(x, x - 1) for x in swapped} | {(x - 1, x) for x in swapped} <= got


def test_windows_of_all_texts_of_a_batch_are_those_of_each():
    rng = random.Random(8)
    line = _words(rng, 12)
    texts = [[], _words(rng, 3), _words(rng, 49), _words(rng, 50), line * 20, _words(rng, 400), line * 9 + _words(rng, 90) + line * 9, ["a"] * 200]
    words, first, _, _ = shingles.word_hashes([" ".join(t).encode() for t in texts])

    def rows(owner, keys, functions, times, places):
        ends = np.cumsum(times)
        return sorted((int(o), int(k), int(f), tuple(places[e - n : e].tolist())) for o, k, f, n, e in zip(owner, keys, functions, times, ends))

    got = rows(*compact_windows.filed_windows(words, first, 5, 50, 25, 2))
    want = []
    for i in range(len(texts)):
        own = words[first[i] : first[i + 1]]
        want += [(i, *r[1:]) for r in rows(*compact_windows.filed_windows(own, np.array([0, len(own)]), 5, 50, 25, 2))]
        if len(own) >= 50:  # and the places are those of the tree, where words beside them fit
            runs, _ = shingles.run_hashes(own, np.array([0, len(own)]), 5)
            for f in range(2):
                tree = {c for _, c, _ in compact_windows.compact_windows(shingles.mix(runs ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (1 << 64) - 1)), 21)}
                filed = {c for o, _, g, p in got if (o, g) == (i, f) for c in p}
                assert filed <= tree and (i not in (3, 5) or {c for c in tree if 10 <= c <= len(own) - 15} <= filed)
    assert got == sorted(want) and {o for o, *_ in got} == {3, 4, 5, 6, 7}


def test_repeated_lines_are_matched_in_few_steps():
    """Two texts made of one line of 30 words, in other pieces: many parts, all of the same runs."""
    import cProfile
    import pstats

    rng = random.Random(9)
    line = _words(rng, 30)
    texts = [" ".join(sum((line + _words(rng, 9 + i) for _ in range(20)), [])).encode() for i in range(2)]
    words, first, _, _ = shingles.word_hashes(texts)
    a, b = words[: first[1]], words[first[1] :]
    shifts = sorted({int(i - k) for i in np.flatnonzero(a == a[0]) for k in np.flatnonzero(b == a[0])})
    calls = cProfile.Profile()
    assert calls.runcall(compact_windows.reordered_on, a, b, shifts, [], 5, 50, 0.8) == []
    assert pstats.Stats(calls).total_calls < 1000 * len(shifts)


def test_files_are_compared_only_where_a_passage_may_be():
    """The look at runs rejects no pair of windows that has a passage, and most that share lines in another order."""
    rng = random.Random(10)
    hashed = lambda t: shingles.word_hashes([" ".join(t).encode()])[0]
    base, lines = _words(rng, 205), [_words(rng, 15) for _ in range(12)]
    pairs = []
    for edits in range(40):
        other = list(base)
        for _ in range(edits):
            place = rng.randrange(len(other))
            other[place : place + rng.randrange(2)] = _words(rng, rng.randrange(2))
        pairs.append((hashed(base), hashed([*base[:95], *other[95:]][:205])))
    for _ in range(40):
        mixed = [sum(rng.sample(lines, 12), []) for _ in range(2)]
        pairs.append(tuple(hashed([*_words(rng, 10), *m[:90], *lines[0], *m[90:]][:205]) for m in mixed))
    kept = []
    for own, centre in pairs:
        rows = np.zeros((2, 201), np.uint16)
        for row, words in zip(rows, (own, centre)):
            runs, _ = shingles.run_hashes(words, np.array([0, len(words)]), 5)
            row[: len(runs)] = runs % np.uint64(65535) + np.uint64(1)
        may = compact_windows._may_have_passage(rows[:1], rows[1], 100, 5, 50, 0.8)[0]
        found = any(p[0] <= 100 and 105 <= p[1] for p in compact_windows.passages_on(own, centre, [0], 5, 50, 0.8))
        assert may or not found
        kept.append(bool(may))
    assert all(kept[:4]) and sum(kept[40:]) < 5


def test_op7_finds_passages_beside_a_line_of_the_first_document(spark):
    """The first document has a line of 40 words twice; others share longer passages around it, exact or edited."""
    rng = random.Random(6)
    line = _words(rng, 40)
    text = lambda *parts: " ".join(sum((list(p) for p in parts), []))
    rows = [(0, text(line, _words(rng, 60), line, after := _words(rng, 30)))]
    for k in range(40):  # of each four, two share an exact passage, two one with another word
        left, right = _words(rng, 12), _words(rng, 12)
        for j in range(4):
            edit = right if j < 2 else [*right[:8], *_words(rng, 1), *right[9:]]
            rows.append((1 + 4 * k + j, text(_words(rng, 20 + 7 * j), left, line, edit, _words(rng, 30))))
    rows.append((500, text(_words(rng, 25), line, after)))
    out = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.other_id) for r in out}
    for k in range(40):
        assert {(1 + 4 * k + j, 1 + 4 * k) for j in (1, 2, 3)} <= pairs
    assert (500, 0) in pairs
    assert all(r.doc_id in (0, 500) or (r.doc_id - 1) // 4 == (r.other_id - 1) // 4 for r in out)


def _passages(spark, texts):
    """Of (id, words): pairs of ids that have a row."""
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    return {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(rows).collect()}


def test_op7_finds_passages_with_members_that_have_one_already(spark):
    """0 and 1 share 79 words each with 2, and 44 with 3: too few. 65 words of 2 and 3 lie in these, at any place."""
    rng = random.Random(8)
    base = _words(rng, 135)
    parts = [base[:79], base[56:], base, base[35:100]]
    got = _passages(spark, [(i, _words(rng, 60 + i) + w + _words(rng, 60)) for i, w in enumerate(parts)])
    assert got == {(0, 2), (2, 0), (1, 2), (2, 1), (2, 3), (3, 2)}


def test_op7_finds_swapped_parts_that_others_have_alone(spark):
    """The halves of a swapped passage stand alone in documents of smaller id, which have no passage with anything."""
    rng = random.Random(9)
    rows, want = [], set()
    for k in range(30):
        one, two, n = _words(rng, 38), _words(rng, 38), 4 * k
        rows += [(n + i, _words(rng, 40) + w + _words(rng, 40)) for i, w in enumerate((one, two, one[-30:], two[-30:]))]
        rows += [(1000 + n + i, _words(rng, 40) + w + _words(rng, 40)) for i, w in enumerate((one + two, two + one))]
        want |= {(1000 + n, 1001 + n), (1001 + n, 1000 + n)}
    assert want <= _passages(spark, rows)


def test_op7_takes_every_text_of_an_id(spark):
    rng = random.Random(10)
    first, second = _words(rng, 60), _words(rng, 60)
    rows = [(0, first), (0, second), (1, _words(rng, 9) + first), (2, second + _words(rng, 9)), (3, _words(rng, 50)), (3, first[:30])]
    got = _passages(spark, rows + rows[:1])
    assert got >= {(1, 0), (2, 0)} and {i for i, _ in got} == {0, 1, 2}


def test_reordered_parts_are_looked_for_where_they_may_be():
    """No two texts of which parts in another order make a passage around the place are left out, with and without repeats."""
    rng, found = random.Random(11), 0
    for case in range(300):
        words = rng.choice(["abcdefghijklmnopqrstuvwxyz0123456789", "abc", "ab"])
        one = [ord(rng.choice(words)) if len(words) < 9 else rng.getrandbits(32) for _ in range(120)]
        cut = rng.randrange(40, 80)
        two = one[cut:] + one[:cut] if case % 3 else [ord(rng.choice(words)) for _ in range(120)]
        for _ in range(rng.randrange(4)):
            two[rng.randrange(120)] = rng.getrandbits(32)
        a, b = np.array(one, np.uint64), np.array(two, np.uint64)
        x, y = (shingles.run_hashes(t, np.array([0, 120]), 5)[0] for t in (a, b))
        passage = compact_windows._reordered(x, y, 5, 50, 0.8, 41)
        if not passage:
            continue
        at, other = passage[0] + 20, passage[2] + 20
        rows = np.zeros((2, 201), np.uint16)
        for row, runs, place in ((rows[0], x, at), (rows[1], y, other)):
            low, high = max(0, place - 100), min(len(runs), place + 101)
            row[100 - place + low : 100 - place + high] = runs[low:high] % np.uint64(65535) + np.uint64(1)
        assert compact_windows._may_be_reordered(rows[:1], rows[1], 100, 5, 50, 0.8)[0]
        found += 1
    assert found > 100
    few = np.arange(1, 202, dtype=np.uint16)
    assert not compact_windows._may_be_reordered(few[None], np.concatenate((few[:40], few[40:] + 1000)), 100, 5, 50, 0.8)[0]


# ---- pseudonyms ------------------------------------------------------------


def test_permutations_are_one_to_one(spark):
    numbers = spark.range(1000).select(F_lpad("id", 3).alias("v"))
    out = numbers.select(pseudonyms.permute_text(numbers.v, "k", "x").alias("p"), pseudonyms.permute_text(numbers.v, "l", "x").alias("q")).toPandas()
    assert len(set(out.p)) == 1000 and set(out.p) == {f"{i:03d}" for i in range(1000)} and (out.p == out.q).mean() < 0.02


def F_lpad(column, n):
    from pyspark.sql import functions as F

    return F.lpad(F.col(column).cast("string"), n, "0")


def test_pseudonyms_keep_their_format(spark):
    import datetime
    import ipaddress

    def luhn(s):
        d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed([c for c in s if c.isdigit()]))]
        return sum(x - 9 * (x > 9) for x in d) % 10 == 0

    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"]
    dates = ["2020-02-29", "1999/12/31", "31.01.2001"]
    rest = ["10.20.30.40", "+1 (017) 555-7713", "a.b7@mail.example.com", "123-45-6789", "GB82 WEST 1234 5698 7654 32"]
    wrong = ["4111 1111 1111 1112", "2021-02-29", "300.1.1.1", "000-12-3456", "GB83 WEST 1234 5698 7654 32"]
    rows = [(i, f"x {v}, y") for i, v in enumerate(cards + dates + rest + wrong)]
    df = spark.createDataFrame(rows + [(99, f"{cards[0]} {cards[0]}")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pseudonyms.pseudonymise(df, "key").collect()}
    got = [out[i][2:-3] for i in range(len(rows))]
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    for old, new in zip(cards + dates + rest[1:], got[:6] + got[7:11]):
        assert old != new and shape(old) == shape(new)
    assert all(map(luhn, got[:3])) and ipaddress.ip_address(got[6])
    for f, v in zip(("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y"), got[3:6]):
        datetime.datetime.strptime(v, f)
    assert got[11:] == wrong
    assert out[99] == f"{got[0]} {got[0]}"


def test_pseudonyms_of_values_beside_other_numbers_and_words(spark):
    """A CVV, an expiry, a list number, a currency or a short number that a candidate took in stays; the value does not."""
    card, iban, austrian, phone = "4111111111111111", "ES9121000418450200051332", "AT611904300234573201", "+1 212 555 0123"
    beside = [("", "4111 1111 1111 1111", " 123"), ("", card, " 12/25"), ("10 ", card, ""), ("", iban, " EUR"),
              ("", austrian, " SEPA"), ("", phone, " 42"), ("", phone, " 1234 56")]
    rows = [(i, f"{a}{v}{b}") for i, (a, v, b) in enumerate(beside)] + [(100 + i, v) for i, (_, v, _) in enumerate(beside)]
    out = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    for i, (a, v, b) in enumerate(beside):
        assert out[100 + i] != v and out[i] == f"{a}{out[100 + i]}{b}"


# ---- sharding --------------------------------------------------------------


def test_hypergeometric_draws_follow_the_law():
    from math import comb

    rng, n = random.Random(2), 20000
    for good, bad, k in ((7, 5, 6), (40, 3, 20), (1, 9, 4)):
        seen = collections.Counter(sharding.draw_hypergeometric(rng, good, bad, k) for _ in range(n))
        for x in range(k + 1):
            p = comb(good, x) * comb(bad, k - x) / comb(good + bad, k)
            assert abs(seen[x] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


@settings(max_examples=30, deadline=None)
@given(blocks=st.lists(st.integers(0, 50), min_size=1, max_size=8), shards=st.integers(1, 6))
def test_matrix_has_the_wanted_sums(blocks, shards):
    n = sum(blocks)
    want = [n // shards + (j < n % shards) for j in range(shards)]
    m = sharding.communication_matrix(blocks, want, 1)
    assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m)] == want and min(map(min, m)) >= 0


# ---- token files -----------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(blocks=st.lists(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 2**31 - 2)), max_size=80), max_size=6))
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    words = token_files.pack_blocks(blocks) if blocks else []
    back = token_files.unpack_blocks(words, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back)) and len(back) == len(blocks)


@pytest.mark.parametrize("ids", [
    [1527017913, 1074960764, 1705212715, 1377792005],
    [1162372455, 1953510857, 1262197908, 1853197753, 1670277036, 1610366725, 1620961343, 1612437375,
     2141342426, 1248667149, 1209126905, 1640923687, 1729205666, 1987679657, 1612044505, 1179703106],
])
def test_a_block_that_ends_a_range_at_a_border_is_coded(ids):
    """The last id leaves the low end one below a border of words, and a range of less than a word."""
    blocks = [np.array([*ids, *range(more)], np.uint32) for more in (0, 1, 50)]
    back = token_files.unpack_blocks(token_files.pack_blocks(blocks), [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))


def test_predictable_ids_are_short_and_damage_is_found(tmp_path):
    ids = np.tile(np.arange(500, 560, dtype=np.uint32), 600)
    path = f"file://{tmp_path}/x.tokids"
    size = token_files.write_file(path, [1, None], [100, len(ids) - 100], ids)
    assert size < len(ids) // 4
    names, lengths, back = token_files.read_file(path)
    assert (names, lengths) == ([1, None], [100, len(ids) - 100]) and np.array_equal(back, ids)
    raw = bytearray((tmp_path / "x.tokids").read_bytes())
    raw[len(raw) // 2] ^= 1
    (tmp_path / "x.tokids").write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        token_files.read_file(path)


def test_op10(spark, texts):
    import zlib

    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json")), 0
    got = QUERIES["op10_context_mixing_files"](spark, SF).toPandas().set_index("doc_id")
    for i, t in sorted(zip(texts.doc_id, texts.text)):
        ids = [*library.encode(t, add_special_tokens=False).ids, token_files.END_ID]
        assert tuple(got.loc[i][["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# ---- toxicity --------------------------------------------------------------


def test_kernel_tolerates_gaps_and_inserted_characters():
    clean = [f"{a}{b}{c}" for a in ("th", "er", "on", "in", "qua") for b in ("ea", "io", "ou", "a") for c in ("nt", "st", "re", "ly", "mp")]
    weights, bias = toxicity.train_words(["idiot", "moron", "worthless", "pathetic", "disgusting", "stupid"], clean)
    model = toxicity.Model(weights, bias, np.zeros(4), 0.0)
    decide = lambda *t: model.decisions([x.encode() for x in t])[:, 0]
    assert (decide("an idiot", "IDIOT!", "i d i o t", "i-d-i-o-t", "idxiot", "w0rthless", "pathettic", "disgustting") > 0).all()
    assert (decide("there is a quaint mouth", "nation", "test") < 0).all()


def test_op5_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_subsequence_toxicity"](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    toxic, caught = held.toxic == 1, held.predicted == 1
    assert (caught & toxic).sum() / toxic.sum() > 0.9 and (caught & ~toxic).sum() / (~toxic).sum() < 0.01
    assert got.score.between(0, 1).all() and len(got) == 10000


# ---- pipeline --------------------------------------------------------------


def test_pipeline_stages_keep_what_they_should(spark, texts):
    import corpus_pipeline

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = columns or docs.columns
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF)
        docs = corpus_pipeline.stored(docs, name)
        held[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert held[name] <= before and docs.count() == len(held[name])
        if name != "bpe":
            assert docs.columns == columns
    classes = QUERIES["op4_dart_minhash"](spark, SF).toPandas()
    assert len(held["toxicity"] - held["near_dedup"]) <= len(classes) - classes.class_id.nunique()
    assert held["decontamination"] == held["pii"] == held["bpe"]
    dirty = QUERIES["op9_benchmark_decontamination"](spark, SF).where("contaminated").toPandas().doc_id
    assert not set(dirty) & held["decontamination"]
    assert held["near_dedup"] - held["decontamination"] <= set(dirty)
