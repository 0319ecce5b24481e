"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

One pattern finds candidates; each is validated (check digits, calendar, ranges)
and then permuted within its format by a Feistel network keyed with a secret, so
equal values get equal pseudonyms in all documents and nothing has to be looked up
or joined. Of a card, IBAN or phone that fails validation, as it took in a number or
word beside it, the longest part between separators that is valid is replaced. Other
candidates that fail stay as they are. A number after a + that is short enough for a
phone together with the next number is one value, but after +1 phones have 11 digits.

The network alternately adds a hash of one half to the other, each within its own
range. That is a permutation of exactly the values of a format, without padding or
retries: dates use 108 x 673 days, addresses 65536 x 65536, texts a shift of each
character in its own class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import free_name, let, table

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FIRST_DAY, _DAYS = "1901-01-01", (108, 673)  # 108 * 673 days: 1901 to 2099
_SSN = (898, 99 * 9999)  # areas 001-899 without 666; group and serial not zero

_DIGITS_FIRST = "|".join(
    [
        r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
        r"\d{4}-\d{2}-\d{2}(?!-?\d)",
        r"\d{4}/\d{2}/\d{2}(?!/?\d)",
        r"\d{2}[./]\d{2}[./]\d{4}",
        r"\d{3}-\d{2}-\d{4}(?!-)",
        r"(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}",
        r"\d(?:[ -]?\d){12,18}",
    ]
)
# one test of what stands before, then branches that differ in their first character
PATTERN = (
    r"(?<![A-Za-z0-9])(?:"
    rf"(?:(?=\d)(?:{_DIGITS_FIRST})|[0-9a-fA-F]{{32,128}}+|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    r"|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}|\(\d{3}\) ?\d{3}[ .-]\d{4})(?![A-Za-z0-9@])(?![._%+-][A-Za-z0-9._%+-]*@)"
    r"|(?<![._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
)


def _chars(s: Column) -> Column:
    return F.array_remove(F.split(s, ""), "")


def _hash(key: str, kind: str, step: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256)


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """Permutation of pairs in range(sizes[0]) x range(sizes[1])."""

    def add(to: Column, other: Column, size: int, step: Column) -> Column:
        h = F.conv(F.left(_hash(key, kind, step, other), F.lit(15)), 16, 10).cast("long")
        return (to + h % size) % size

    def step(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(add(acc["l"], acc["r"], sizes[0], i).alias("l"), acc["r"].alias("r"))
        ).otherwise(F.struct(acc["l"].alias("l"), add(acc["r"], acc["l"], sizes[1], i).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_text(text: Column, key: str, kind: str, classes: tuple[str, ...] = (DIGITS,)) -> Column:
    """Permutation of texts in which every character stays in its class.

    Characters of a class are shifted by hash bytes of the other half, all others
    stay. A text of one character is shifted by a constant.
    """

    def shifted(half: Column, other: Column, step: Column) -> Column:
        def one(c: Column, i: Column, h: Column) -> Column:
            k = F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for letters in classes:
                at = F.instr(F.lit(letters), c)
                moved = F.substr(F.lit(letters), F.pmod(at - 1 + k, F.lit(len(letters))) + 1, F.lit(1))
                out = F.when(at > 0, moved).otherwise(out)
            return out

        return let(
            _hash(key, kind, step, other),
            lambda h: F.array_join(F.transform(_chars(half), lambda c, i: one(c, i, h)), ""),
        )

    def step(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(shifted(acc["l"], acc["r"], i).alias("l"), acc["r"].alias("r"))
        ).otherwise(F.struct(acc["l"].alias("l"), shifted(acc["r"], acc["l"], i).alias("r")))

    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.left(text, half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    return F.reduce(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"])
    )


def luhn_sum(digits: Column) -> Column:
    """Sum modulo 10 with every second digit from the right doubled; 0 for a valid number."""
    parts = F.transform(
        _chars(F.reverse(digits)),
        lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )
    return F.reduce(parts, F.lit(0), lambda a, x: (a + x) % 10)


def mod97(text: Column) -> Column:
    """Letters as 10 to 35, the digits as one number, modulo 97."""

    def step(a: Column, c: Column) -> Column:
        letter = F.instr(F.lit(UPPER), c) + 9
        return F.when(letter > 9, (a * 100 + letter) % 97).otherwise((a * 10 + c.cast("int")) % 97)

    return F.reduce(_chars(text), F.lit(0), step)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(value: Column, new: Column, kept: str = "[0-9]") -> Column:
    """``value`` with its characters of a class replaced, in order, by those of ``new``."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(
            c.rlike(kept),
            F.struct(F.concat(acc["out"], F.substr(new, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))

    return F.reduce(
        _chars(value), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda acc: acc["out"]
    )


def _email(v: Column, key: str) -> Column:
    name, host = F.split_part(v, F.lit("@"), F.lit(1)), F.split_part(v, F.lit("@"), F.lit(2))
    return F.concat(permute_text(name, key, "email", (DIGITS, LOWER, UPPER)), F.lit("@"), host)


def _address(v: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        n = F.transform(parts, lambda x: x.cast("int"))
        pair = permute_pair(F.get(n, 0) * 256 + F.get(n, 1), F.get(n, 2) * 256 + F.get(n, 3), (65536, 65536), key, "ip")
        new = let(pair, lambda p: F.concat_ws(".", *[(F.floor(p[h] / d) % 256).cast("string") for h in "lr" for d in (256, 1)]))
        return F.when(F.forall(n, lambda x: x < 256), new).otherwise(v)

    return let(F.split(v, r"\."), of)


def _date(v: Column, key: str) -> Column:
    """Calendar days 1901 to 2099, year first, or month or day first."""
    n = F.transform(F.split(v, "[-./]"), lambda x: x.cast("int"))

    def day(y: Column, m: Column, d: Column) -> Column:
        fits = (y >= 1901) & (y <= 2099) & (m >= 1) & (m <= 12) & (d >= 1)
        return F.when(fits, let(F.make_date(y, m, F.lit(1)), lambda t: F.when(d <= F.day(F.last_day(t)), F.date_add(t, d - 1))))

    def moved(t: Column) -> Column:
        at = F.datediff(t, F.lit(_FIRST_DAY).cast("date"))
        pair = permute_pair(F.floor(at / _DAYS[1]), at % _DAYS[1], _DAYS, key, "date")
        return let(pair, lambda p: F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["l"] * _DAYS[1] + p["r"]).cast("int")))

    def written(t: Column, order: str) -> Column:
        return F.when(t.isNotNull(), let(moved(t), lambda x: _refill(v, F.date_format(x, order))))

    def of(n: Column) -> Column:
        a, b, c = (F.get(n, k) for k in range(3))
        first = F.when(v.rlike("^[0-9]{4}"), written(day(a, b, c), "yyyyMMdd")).otherwise(
            F.when(F.contains(v, F.lit("/")), written(day(c, a, b), "MMddyyyy"))
        )
        return F.coalesce(first, F.when(~v.rlike("^[0-9]{4}"), written(day(c, b, a), "ddMMyyyy")), v)

    return let(n, of)


def _ssn(v: Column, key: str) -> Column:
    d = _digits(v)
    area, group, serial = (F.substr(d, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - 1 - (area > 666).cast("int")

    def text(p: Column) -> Column:
        a = p["l"] + 1 + (p["l"] >= 665).cast("int")
        return F.concat(
            F.lpad(a.cast("string"), 3, "0"),
            F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"),
        )

    pair = permute_pair(index, (group - 1) * 9999 + serial - 1, _SSN, key, "ssn")
    return F.when(valid, _refill(v, let(pair, text))).otherwise(v)


def _part(v: Column, separators: str, fits: Callable[[Column], Column], new: Callable[[Column], Column]) -> Column:
    """``v`` with its longest part between separators that fits, of equals the first, replaced; ``v`` if none fits."""
    n = F.length(v)
    cut = lambda i: F.substr(v, i, F.lit(1)).rlike(separators)

    def put_in(p: Column) -> Column:
        start = -p["back"]
        replaced = let(F.substr(v, start, p["n"]), new)
        return F.when(p.isNull(), v).otherwise(F.concat(F.left(v, start - 1), replaced, F.substr(v, start + p["n"], n)))

    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | cut(i - 1))
    ends = F.filter(F.sequence(F.lit(1), n), lambda j: (j == n) | cut(j + 1))
    pairs = F.flatten(F.transform(starts, lambda i: F.transform(ends, lambda j: F.struct((j - i + 1).alias("n"), (-i).alias("back")))))
    parts = F.filter(pairs, lambda p: (p["n"] >= 8) & fits(F.substr(v, -p["back"], p["n"])))
    whole = F.struct(n.alias("n"), F.lit(-1).alias("back"))
    return let(F.when(fits(v), whole).otherwise(F.array_max(parts)), put_in)


def _iban(v: Column, key: str) -> Column:
    def fits(t: Column) -> Column:
        s = F.replace(t, F.lit(" "), F.lit(""))
        return F.length(s).between(15, 34) & s.rlike("^[A-Z]{2}[0-9]{2}") & (mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.left(s, F.lit(4)))) == 1)

    def new(t: Column) -> Column:
        s = F.replace(t, F.lit(" "), F.lit(""))
        country = F.left(s, F.lit(2))

        def checked(body: Column) -> Column:
            rest = mod97(F.concat(body, country, F.lit("00")))
            return _refill(t, F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body), "[A-Z0-9]")

        return let(permute_text(F.substr(s, F.lit(5), F.length(s)), key, "iban", (DIGITS, UPPER)), checked)

    return _part(v, " ", fits, new)


def _phone(v: Column, key: str) -> Column:
    """The national number; the country code of +1 numbers, else two digits after a +, stay."""

    def fits(t: Column) -> Column:
        n = F.length(_digits(t))
        first = F.startswith(v, t)  # a part that does not begin the candidate has no country code
        return first & F.when(t.rlike("^[+]1($|[^0-9])") & _digits(v).rlike("^[0-9]{11}"), n == 11).otherwise(n.between(8, 15))

    def new(t: Column) -> Column:
        def of(d: Column) -> Column:
            kept = F.when(F.length(d) == 10, 0).when((F.length(d) == 11) & d.startswith("1"), 1).otherwise(2)
            kept = F.when(F.startswith(t, F.lit("+")) | (F.length(d) > 10), kept).otherwise(0)
            return _refill(t, F.concat(F.left(d, kept), permute_text(F.substr(d, kept + 1, F.length(d)), key, "phone")))

        return let(_digits(t), of)

    return _part(v, "[ .-]", fits, new)


def _card(v: Column, key: str) -> Column:
    def fits(t: Column) -> Column:
        return let(_digits(t), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) == 0))

    def new(t: Column) -> Column:
        def checked(body: Column) -> Column:
            return _refill(t, F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))

        d = _digits(t)
        return let(permute_text(F.left(d, F.length(d) - 1), key, "card"), checked)

    return _part(v, "[ -]", fits, new)


def pseudonym(v: Column, key: str) -> Column:
    """Pseudonym of one candidate, by the first format that its shape fits."""
    return (
        F.when(F.contains(v, F.lit("@")), _email(v, key))
        .when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _address(v, key))
        .when(v.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), _date(v, key))
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(v, key))
        .when(v.rlike(r"^[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){2}"), _iban(v, key))
        .when(v.rlike(r"^[0-9]*[a-fA-F][0-9a-fA-F]*$"), permute_text(v, key, "secret", (DIGITS, LOWER[:6], UPPER[:6])))
        .when(v.rlike(r"^(\+|\(|(1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}$)"), _phone(v, key))
        .when(F.length(_digits(v)).between(13, 19), _card(v, key))
        .otherwise(v)
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal values in ``text``; add ``n_pseudonyms``.

    A text is cut at the candidates and put together again with the pseudonyms in
    their places, so a pseudonym is never taken for another value. A value that is
    its own pseudonym (one in the size of its format) is not counted. Null texts
    stay null with a count of 0. Other columns stay; ``n_pseudonyms`` is replaced
    if it exists. The key is a literal of the plan: whoever reads plans or event
    logs can read it.
    """
    (out,) = free_name(df, "out")

    def of(values: Column) -> Column:
        def put_in(new: Column) -> Column:
            pieces = F.split(F.col(text), PATTERN, -1)
            return F.struct(
                F.array_join(F.flatten(F.zip_with(pieces, F.coalesce(new, F.array()), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "").alias("text"),
                F.size(F.filter(new, lambda x, i: x != F.get(values, i))).cast("long").alias("n"),
            )

        return F.when(
            F.size(values) > 0, let(F.transform(values, lambda v: pseudonym(v, key)), put_in)
        ).otherwise(F.struct(F.col(text).alias("text"), F.lit(0).cast("long").alias("n")))

    found = let(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)), of)
    names = [c for c in df.columns if c != "n_pseudonyms"]
    df = df.select(*names, found.alias(out))
    return df.select(
        *[F.col(f"{out}.text").alias(c) if c == text else c for c in names],
        F.coalesce(F.col(f"{out}.n"), F.lit(0).cast("long")).alias("n_pseudonyms"),
    )


QUERY_KEY = "pseudonym key of the registered query"


def op3_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)


QUERIES = {"op3_feistel_pseudonyms": op3_feistel_pseudonyms}
ORACLE: dict[str, str] = {}
