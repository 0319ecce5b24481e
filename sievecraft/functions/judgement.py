"""Judge scores and test statuses held as JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import let, strip

# Score names and the lowest score that passes.
MIN_SCORES = {
    "requirement_conformance": 5,
    "logical_correctness": 5,
    "edge_case_consideration": 4,
}
CARRIED_SCORE = "edge_case_consideration"
PASS_STATUS = "pass"

_OPTIONS = {"allowSingleQuotes": "false"}


def _one_value(c: Column, item_type: str, mark: Callable[[Column], Column], mark_of: Callable[[Column], Column]) -> Column:
    """Parse ``c`` as exactly one JSON value of ``item_type``, else null, in one pass.

    The parser stops after the first complete value, so text behind it would go
    unnoticed. ``c`` is therefore put into an array between two marks, values of its
    own type that hold the MD5 of ``c``. Text that closes this array, or opens
    another one under the same name, leaves an array without either mark, and cannot
    bring its own, since it would have to contain its own MD5.
    """

    def of(md5: Column) -> Column:
        text = F.concat(F.lit('{"v":['), mark(md5), F.lit(","), c, F.lit(","), mark(md5), F.lit("]}"))
        items = F.from_json(text, f"struct<v:array<{item_type}>>", _OPTIONS)["v"]
        whole = lambda v: (F.size(v) == 3) & (mark_of(v[0]) == md5) & (mark_of(v[2]) == md5)
        return let(items, lambda v: F.when(whole(v), v[1]))

    return let(F.md5(c), of)


def _is_bare(judgement: Column, name: str) -> Column:
    """The score of ``name`` is a bare NaN or infinity in the text, not a quoted one."""
    return F.regexp_like(judgement, F.lit(rf'"{name}"\s*:\s*\{{[^{{}}]*"score"\s*:\s*[NI+-]'))


def judge_scores(judgement: Column, names=tuple(MIN_SCORES)) -> Column:
    """Struct of nested structs ``name.score``; null where the JSON is unusable.

    Bare NaN and infinities are numbers, as they are for a lenient reader. The parser
    takes them in quotes too; a quoted score makes the judgement unusable.
    """
    fields = ",".join(f"{n}:struct<score:double>" for n in names)
    mark = lambda m: F.concat(F.lit('{"_mark":"'), m, F.lit('"}'))
    parsed = _one_value(judgement, f"struct<{fields},_mark:string>", mark, lambda v: v["_mark"])

    def numbers(s: Column) -> Column:
        quoted = F.lit(False)
        for n in names:
            x = s[n]["score"]
            odd = F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
            quoted = quoted | (odd & ~_is_bare(judgement, n))
        return F.when(~quoted, s)

    return let(parsed, numbers)


def scores_pass(scores: Column, mins: dict[str, float] = MIN_SCORES) -> Column:
    """All scores reach their minimum. A missing score counts as 0."""
    test = F.lit(True)
    for name, low in mins.items():
        test = test & (scores[name]["score"] >= low)
    return F.coalesce(test, F.lit(False))


def all_tests_pass(statuses: Column) -> Column:
    """Every status equals "pass"; an empty array passes, anything else fails."""
    mark = lambda m: F.concat(F.lit('["'), m, F.lit('"]'))
    items = _one_value(statuses, "array<string>", mark, lambda v: F.get(v, F.lit(0)))
    every = F.forall(items, lambda s: s.eqNullSafe(F.lit(PASS_STATUS)))
    # An object is no array, but says so only by its first character.
    return F.coalesce(F.startswith(strip(statuses), F.lit("[")) & every, F.lit(False))


def passing_score(
    judgement: Column, statuses: Column, mins: dict[str, float] = MIN_SCORES, carried: str = CARRIED_SCORE
) -> Column:
    """The carried score of a row that passes both tests, else null.

    Each text is parsed once, the statuses only where the scores pass.
    """
    return let(
        judge_scores(judgement, tuple(mins)),
        lambda s: F.when(F.when(scores_pass(s, mins), all_tests_pass(statuses)), s[carried]["score"]),
    )


def judge_pass(judgement: Column, statuses: Column, mins: dict[str, float] = MIN_SCORES) -> Column:
    return passing_score(judgement, statuses, mins).isNotNull()
