"""A vocabulary as one constant of the plan, looked up inside the row."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of a dictionary that becomes part of the plan: a tokenizer of 128 thousand
# pieces takes some 4 MB.
DICTIONARY_BYTES = 16 << 20
_ENTRY_BYTES = 32  # of an entry besides its piece, at most


@dataclass(frozen=True)
class TokenDictionary:
    """Pieces by token id, dealt to buckets by the hash of the id.

    The text of ``buckets`` is a literal that the optimizer parses once, when it
    folds constants; a lookup is one array access and a look at the one or two
    entries there, however large the vocabulary is and whatever its ids are.
    """

    text: str
    buckets: int

    @cached_property
    def _entries(self) -> Column:
        return F.from_json(F.lit(self.text), "array<array<struct<i:bigint,p:string>>>")

    def piece(self, token: Column) -> Column:
        """The text of a token, null for a null token and one that has none."""
        bucket = F.pmod(F.xxhash64(token.cast("bigint")), F.lit(self.buckets)).cast("int")
        there = F.filter(F.get(self._entries, bucket), lambda e: e["i"] == token)
        return F.when(token.isNotNull(), F.get(there, F.lit(0))["p"])

    def pieces(self, tokens: Column) -> Column:
        return F.transform(tokens, self.piece)


def token_dictionary(vocabulary: DataFrame, limit: int = DICTIONARY_BYTES) -> TokenDictionary | None:
    """The dictionary of ``vocabulary`` (token_id, piece, is_special), or None beyond ``limit`` bytes.

    The size is measured, not estimated, before anything comes to the driver.
    Special tokens have no text and are left out.
    """
    named = vocabulary.where("NOT is_special AND piece IS NOT NULL").select(F.col("token_id").cast("bigint").alias("i"), F.col("piece").alias("p"))
    # escapes make six bytes of a control character at most
    size = named.agg(F.count("*").alias("n"), F.sum(F.octet_length("p") + 5 * F.regexp_count("p", F.lit(r"[\x00-\x1f\x22\x5c]")))).first()
    if (size[1] or 0) + size.n * _ENTRY_BYTES > limit:
        return None
    buckets = 1 << max(0, size.n - 1).bit_length()
    slots: list[list | None] = [None] * buckets
    for b, i, p in named.select(F.pmod(F.xxhash64("i"), F.lit(buckets)), "i", "p").collect():
        slots[b] = [*(slots[b] or []), {"i": i, "p": p}]
    return TokenDictionary(json.dumps(slots, ensure_ascii=False, separators=(",", ":")), buckets)
