"""BPE as a streaming transducer, and the way back from ids to text.

A merge list is proper if every token is made by one merge, of parts that are made
earlier. For proper lists two facts make streaming possible:

* A cut into tokens is the BPE result exactly if each two neighbours would stay
  apart on their own, so the last token of every prefix follows from the tokens of
  shorter prefixes (``neighbours_stay`` runs the merges of a pair backwards).
* What stands to the right can reach a boundary only through a chain of merges of
  falling rank. The longest such chain bounds the number of symbols that matter;
  ``sufficient_lookahead`` computes the bound from the merge list. A token is final
  once that many symbols behind its end were read.

``WordStream`` uses both to encode a word of any length in constant memory;
``TextStream`` adds the tokenizer's normalising and word splitting, also on pieces
of a text; ``DecodeStream`` turns ids to text with an incremental UTF-8 automaton.
Short words repeat, so whole words are looked up in a bounded cache first.
"""

import codecs
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sievecraft.llm.common import bounded_batches, release_memory, stored, table

CACHE_WORDS, CACHE_RUNS, CACHE_PAIRS, PIECE, LONG_WORD = 1 << 16, 1 << 17, 1 << 18, 1 << 16, 1 << 10
_SPACE = r"\p{White_Space}"
_NO_SPACE = "\x1c\x1d\x1e\x1f"  # str.split and str.isspace take these for white space
_NO_WHITE_SPACE = re.compile(f"[{_NO_SPACE}]")
_WORD_END = 0x100000  # added to the code point of a symbol that ends its word


def byte_characters() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merges of a BPE model over symbols, one character each."""

    def __init__(self, model: dict):
        suffix = model.get("end_of_word_suffix") or ""
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("only plain BPE models, with or without a word end, are supported")

        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix):
                body = token[: -len(suffix)]
                return body[:-1] + chr(_WORD_END + ord(body[-1])) if body else token
            return token

        self.marks_end = bool(suffix)
        self.ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.rank, self.parts, self.pair_rank = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = (symbols(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if a + b in self.rank or any(len(x) > 1 and x not in self.rank for x in (a, b)):
                raise ValueError(f"not a proper merge list at {pair}")
            self.rank[a + b], self.parts[a + b], self.pair_rank[a, b] = r, (a, b), r
        self.longest = max(map(len, self.rank), default=1)
        self.lookahead = self.sufficient_lookahead()
        self._stay: dict[tuple[str, str], bool] = {}
        self.longest_first = ahocorasick.Automaton()
        for token in self.ids:
            if len(token) == 1 or token in self.rank:
                self.longest_first.add_word(token, token)
        self.longest_first.make_automaton()

    def _right_edge(self, token: str) -> Iterator[str]:
        yield token
        while token in self.parts:
            token = self.parts[token][1]
            yield token

    def sufficient_lookahead(self) -> int:
        """Symbols behind a token that can decide whether it is one.

        Behind x, a merge (x, c) takes c away from what follows unless a merge of
        lower rank takes an end of c first, and so on: ``reach[x]`` is the length of
        the longest chain of such merges, built up in order of rank.
        """
        reach: dict[str, int] = {}
        for (x, c), _ in sorted(self.pair_rank.items(), key=lambda item: item[1]):
            behind = max((reach.get(y, 0) for y in self._right_edge(c)), default=0)
            reach[x] = max(reach.get(x, 0), len(c) + behind)
        return max(reach.values(), default=0) + 1

    def neighbours_stay(self, a: str, b: str) -> bool:
        """Whether the text a + b is cut into just a and b."""
        known = self._stay.get((a, b))
        if known is not None:
            return known
        x, y, before, out = a, b, len(self.rank), True
        while True:
            if self.pair_rank.get((x, y), before) < before:
                out = False  # they meet while both exist, and merge
                break
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:  # the left one is younger: before it, its right part stood here
                before, x = rx, self.parts[x][1]
            else:  # of equal merges the left one comes first, so this one had not run
                before, y = ry + 1, self.parts[y][0]
        if len(self._stay) >= CACHE_PAIRS:
            self._stay.clear()
        self._stay[a, b] = out
        return out

    def cut(self, text: str) -> list[str]:
        """Tokens of a text.

        Only one cut has neighbours that all stay apart. Mostly it takes the longest
        token at each place; if not, it is searched for with steps back.
        """
        out = [token for _, token in self.longest_first.iter_long(text)]
        stay = self._stay.get
        for pair in zip(out, out[1:]):
            known = stay(pair)
            if not known and (known is False or not self.neighbours_stay(*pair)):
                return self.search(text)
        return out

    def search(self, text: str) -> list[str]:
        """The last token of every prefix, from the shortest on, and back from the end."""
        stay, last = self._stay.get, [None] * (len(text) + 1)
        for end, token in self.longest_first.iter(text):
            end += 1
            if last[end] is None:
                start = end - len(token)
                if not start:
                    last[end] = token
                elif before := last[start]:
                    known = stay((before, token))
                    if known or (known is None and self.neighbours_stay(before, token)):
                        last[end] = token
        out, end = [], len(text)
        while end:
            token = last[end]
            out.append(token)
            end -= len(token)
        return out[::-1]


class WordStream:
    """Ids of one word that comes in pieces; holds a few look-aheads of symbols."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, ""
        self.limit = 4 * (merges.lookahead + merges.longest)

    def feed(self, symbols: str) -> Iterator[int]:
        for at in range(0, len(symbols), self.limit):
            self.held += symbols[at : at + self.limit]
            keep = self.merges.lookahead + 1  # the last symbol may yet become a word end
            if len(self.held) > 2 * keep:
                done = 0
                for token in self.merges.cut(self.held):
                    if done + len(token) + keep > len(self.held):
                        break
                    done += len(token)
                    yield self.merges.ids[token]
                self.held = self.held[done:]

    def finish(self) -> Iterator[int]:
        held = self.held
        if held and self.merges.marks_end:
            held = held[:-1] + chr(_WORD_END + ord(held[-1]))
        yield from (self.merges.ids[t] for t in self.merges.cut(held))
        self.held = ""


class _Kept(dict):
    """Text -> 32-bit little-endian ids, made on demand.

    Of two generations of at most ``size`` texts the older goes when the younger is
    full; what is asked for again moves to the younger.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def make(self, text: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            out = self.make(text)
            if len(text) > 64:
                return out
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[text] = out
        return out


class _Words(_Kept):
    """Ids of single words."""

    def __init__(self, merges: Merges):
        super().__init__(CACHE_WORDS)
        self.merges, self.table = merges, str.maketrans({chr(b): c for b, c in byte_characters().items()})

    def symbols(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table)

    def make(self, word: str) -> bytes:
        symbols, merges = self.symbols(word), self.merges
        if len(symbols) <= merges.longest:  # no need to stream
            if merges.marks_end:
                symbols = symbols[:-1] + chr(_WORD_END + ord(symbols[-1]))
            ids = [merges.ids[t] for t in merges.cut(symbols)]
        else:
            stream = WordStream(merges)
            ids = [*stream.feed(symbols), *stream.finish()]
        return struct.pack(f"<{len(ids)}I", *ids)


class _Runs(_Kept):
    """Ids of the words between two white spaces."""

    def __init__(self, tokenizer: "Tokenizer"):
        super().__init__(CACHE_RUNS)
        self.tok = tokenizer

    def make(self, run: str) -> bytes:
        text = self.tok.normalise(run)
        if text.isascii() and text.isalpha():
            return self.tok.words[text]
        return b"".join(map(self.tok.words.__getitem__, self.tok.pattern.findall(text)))


class Tokenizer:
    """The parts of a tokenizer file that the streams need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self.words, self.runs = _Words(self.merges), _Runs(self)
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.special.items()}
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.steps = {s["type"] for s in steps}
        if unknown := self.steps - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers {unknown} are not supported")
        pre = spec["pre_tokenizer"]
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre])]
        if kinds != ["Split", "ByteLevel"] or not pre["pretokenizers"][0]["invert"]:
            raise ValueError("only a word pattern followed by byte level is supported")
        self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.byte_of = {c: b for b, c in byte_characters().items()}
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower() if "Lowercase" in self.steps else text
        if "NFC" in self.steps:
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.steps:  # character by character: no final sigma
            text = text.replace("Σ", "σ").lower()
        return text


class TextStream:
    """Ids of one text that comes in pieces, as 32-bit little-endian bytes.

    Pieces are cut behind white space, where words, normal forms and special tokens
    cannot reach across. A run without white space is cut where two characters do
    not compose; its last words stay open, and a long open word goes on in a
    ``WordStream``.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tok, self.raw, self.open, self.run = tokenizer, "", "", None
        self.hold = max((len(s) for s in tokenizer.special), default=0)

    def feed(self, piece: str) -> Iterator[bytes]:
        self.raw += piece
        cut = next((i + 1 for i in range(len(self.raw) - 1, -1, -1) if self.raw[i].isspace() and self.raw[i] not in _NO_SPACE), 0)
        if not cut and len(self.raw) > LONG_WORD:
            cut = self._inner_cut()
            if cut:
                segment, self.raw = self.raw[:cut], self.raw[cut:]
                yield from self._segment(segment, False)
        elif cut:
            segment, self.raw = self.raw[:cut], self.raw[cut:]
            yield from self._segment(segment, True)

    def finish(self) -> Iterator[bytes]:
        segment, self.raw = self.raw, ""
        yield from self._segment(segment, True)

    def _inner_cut(self) -> int:
        """A place where characters do not compose and no special token is open, or 0."""
        raw = self.raw
        for c in range(len(raw) - 1 - self.hold, max(0, len(raw) - LONG_WORD), -1):
            apart = unicodedata.combining(raw[c]) == 0 and unicodedata.is_normalized("NFC", raw[c - 1 : c + 1])
            if apart and "<" not in raw[max(0, c - self.hold) : c]:
                return c
        return 0

    def _segment(self, segment: str, closed: bool) -> Iterator[bytes]:
        special = self.tok.special_pattern
        while any(s in segment for s in self.tok.special) and (m := special.search(segment)):
            yield from self._plain(segment[: m.start()], True)
            yield np.uint32(self.tok.special[m.group()]).astype("<u4").tobytes()
            segment = segment[m.end() :]
        yield from self._plain(segment, closed)

    def _plain(self, segment: str, closed: bool) -> Iterator[bytes]:
        if closed and not self.run and not self.open and not _NO_WHITE_SPACE.search(segment):
            yield b"".join(map(self.tok.runs.__getitem__, segment.split()))
            return
        text = self.tok.normalise(segment)
        if self.run:
            stream, alike = self.run
            more = alike.match(text)
            if more:
                yield np.array([*stream.feed(self.tok.words.symbols(more.group()))], "<u4").tobytes()
                text = text[more.end() :]
            if text or closed:
                yield np.array([*stream.finish()], "<u4").tobytes()
                self.run = None
        text, self.open = self.open + text, ""
        if closed:
            yield b"".join(map(self.tok.words.__getitem__, self.tok.pattern.findall(text)))
            return
        found = list(self.tok.pattern.finditer(text))
        if not found:
            return
        whole, last = found[:-2], found[-1]
        if len(last.group()) > LONG_WORD:  # its start is settled; only its end is open
            yield b"".join(self.tok.words[m.group()] for m in found[:-1])
            letters = regex.match(r"\p{L}", last.group())
            stream = WordStream(self.tok.merges)
            self.run = stream, regex.compile(r"\p{L}+" if letters else rf"[^{_SPACE}\p{{L}}\p{{N}}]+")
            yield np.array([*stream.feed(self.tok.words.symbols(last.group()))], "<u4").tobytes()
            return
        yield b"".join(self.tok.words[m.group()] for m in whole)
        self.open = text[found[-2].start() if len(found) > 1 else last.start() :]


class DecodeStream:
    """Text of ids that come in pieces.

    With a byte-level decoder an automaton takes bytes and gives characters as soon
    as they are whole; broken bytes become U+FFFD. Without a decoder tokens are
    written as they are, with a space between.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tok, self.first = tokenizer, True
        self.bytes = tokenizer.byte_of
        self.automaton = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        tokens = list(map(self.tok.tokens.__getitem__, ids))
        if not self.tok.byte_level_decoder:
            out = ("" if self.first or not tokens else " ") + " ".join(tokens)
            self.first = self.first and not tokens
            return out
        raw = "".join(tokens)
        try:
            return self.automaton.decode(bytes(map(self.bytes.__getitem__, raw)))
        except KeyError:  # a special token with other characters
            return "".join(
                self.automaton.decode(bytes(self.bytes[c] for c in t) if all(c in self.bytes for c in t) else t.encode())
                for t in tokens
            )

    def finish(self) -> str:
        return self.automaton.decode(b"", True)


def encode_text(tokenizer: Tokenizer, text: str) -> bytes:
    stream, out = TextStream(tokenizer), []
    for at in range(0, len(text), PIECE):
        out.extend(stream.feed(text[at : at + PIECE]))
    out.extend(stream.finish())
    return b"".join(out)


def decode_ids(tokenizer: Tokenizer, ids: np.ndarray) -> str:
    stream = DecodeStream(tokenizer)
    return "".join([*(stream.feed(ids[at : at + PIECE].tolist()) for at in range(0, len(ids), PIECE)), stream.finish()])


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One tokenizer per task and path."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _ids_array(parts: list[bytes]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(parts), "<i4"))


def encode(text: Column | str, path: str) -> Column:
    """Ids of a text as array<int>; null is the empty text, so it gives an empty array."""

    @arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = load(path)
        for texts in batches:
            yield _ids_array([encode_text(tok, t.as_py() or "") for t in texts])
        del tok
        _LOADED.clear()
        release_memory()

    return ids_of(text)


def decode(ids: Column | str, path: str) -> Column:
    """Text of an array of ids; a null array gives the empty text, an unknown id fails."""

    @arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = load(path)
        for lists in batches:
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            yield pa.array(
                [decode_ids(tok, values[ends[i] : ends[i + 1]]) for i in range(len(lists))], pa.string()
            )

    return text_of(ids)


def round_trip(text: Column | str, path: str) -> Column:
    """struct(ids, decoded): ``encode`` and ``decode`` of its ids in one Python worker."""

    @arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = load(path)
        for texts in batches:
            parts = [encode_text(tok, t.as_py() or "") for t in texts]
            decoded = pa.array([decode_ids(tok, np.frombuffer(p, "<i4")) for p in parts], pa.string())
            yield pa.StructArray.from_arrays([_ids_array(parts), decoded], ["ids", "decoded"])
        del tok
        _LOADED.clear()
        release_memory()

    return both(text)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_streaming_bpe(spark, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", round_trip("text", path).alias("both"))
    digests = docs.select("doc_id", "both.*").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    with bounded_batches(spark):
        return stored(digests, "encoded")


QUERIES = {"op6_streaming_bpe": op6_streaming_bpe}
ORACLE: dict[str, str] = {}
