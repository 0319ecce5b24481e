"""Token-id files, packed by a context-mixing range coder.

Ids are coded in blocks that start from an empty model and carry a CRC-32, so any
block can be decoded, checked or lost alone. For the next id, tables remember what
followed the last two ids (order 2) and the last id (order 1) when they were seen
before, with a count of how often that was right. A first symbol says which of the
two predictions is right, if any; its probabilities mix counts kept for the present
confidence of both predictions with counts over all of the block. An id that neither
predicts is coded by its bit length, with adaptive counts (order 0), and its low bits.

Blocks are independent, so many are coded side by side: step n codes the n-th id of
all blocks of a file with array operations.
"""

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.bpe import tokenizer_path
from sievecraft.llm.common import stored, table
from sievecraft.session import shared_path

BLOCK_IDS, LANES, PART_BYTES, END_ID = 8192, 1024, 32 << 20, 2
_MAGIC = b"TOKIDS01"
_TABLE, _CLASSES = 12, 33  # bits of a context table; bit lengths 0 to 32
_BITS, _LOW, _BYTE = np.uint64(32), np.uint64((1 << 16) - 1), np.uint64(16)
_MASK = np.uint64((1 << 48) - 1)
_ONE = np.uint64(1)


class _Lanes:
    """The model of every block: context tables and counts. The same for both directions."""

    def __init__(self, lanes: int):
        self.n, self.row, self.steps = lanes, np.arange(lanes), 0
        self.two, self.one = (np.zeros(lanes << _TABLE, np.int64) for _ in range(2))
        self.flags = [np.ones(lanes * 32, np.int64) for _ in range(3)]
        self.all_flags = [np.ones(lanes, np.int64) for _ in range(3)]
        self.sizes = np.ones((lanes, _CLASSES), np.int64)
        self.size_ends = np.tile(np.arange(_CLASSES + 1), (lanes, 1))
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def shrink(self, lanes: int) -> None:
        self.n, self.row = lanes, self.row[:lanes]
        self.two, self.one = self.two[: lanes << _TABLE], self.one[: lanes << _TABLE]
        self.flags, self.all_flags = [f[: lanes * 32] for f in self.flags], [f[:lanes] for f in self.all_flags]
        self.sizes, self.size_ends = self.sizes[:lanes], self.size_ends[:lanes]
        self.last, self.before = self.last[:lanes], self.before[:lanes]

    def predict(self) -> None:
        mask = (1 << _TABLE) - 1
        self.at_two = (self.row << _TABLE) + (((self.last * 0x9E3779B1 + self.before * 0x85EBCA77) >> 15) & mask)
        self.at_one = (self.row << _TABLE) + ((self.last * 0x9E3779B1 >> 15) & mask)
        self.held_two, self.held_one = self.two[self.at_two], self.one[self.at_one]
        self.guess_two, self.guess_one = self.held_two >> 2, self.held_one >> 2
        agree = self.guess_two == self.guess_one
        self.context = (self.row << 5) + (agree << 4) + ((self.held_two & 3) << 2) + (self.held_one & 3)
        mixed = [4 * f[self.context] + g for f, g in zip(self.flags, self.all_flags)]
        self.ends = [np.zeros(self.n, np.int64), mixed[0], mixed[0] + mixed[1], mixed[0] + mixed[1] + mixed[2]]

    def kind(self, ids: np.ndarray) -> np.ndarray:
        """0: the order-2 prediction, 1: only the order-1 prediction, 2: neither. (ids are stored plus one)"""
        return np.where(ids == self.guess_two, 0, np.where(ids == self.guess_one, 1, 2))

    def bounds(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.choose(kind, self.ends[:3])
        return start, np.choose(kind, self.ends[1:]) - start

    def learn(self, ids: np.ndarray, kind: np.ndarray) -> None:
        for k in range(3):
            lanes = np.flatnonzero(kind == k)
            self.flags[k][self.context[lanes]] += 24
            self.all_flags[k][lanes] += 8
        self.steps += 1
        if self.steps % 64 == 0:  # counts stay below 2**14: a step adds 24 at most
            for few in (self.flags, self.all_flags):
                full = np.flatnonzero(few[0] + few[1] + few[2] > 4000)
                for f in few:
                    f[full] = (f[full] + 1) >> 1
        if self.steps & (self.steps - 1) == 0 or self.steps % 64 == 0:
            full = np.flatnonzero(self.sizes.sum(axis=1) > 16000)
            self.sizes[full] = (self.sizes[full] + 1) >> 1
            np.cumsum(self.sizes, axis=1, out=self.size_ends[:, 1:])
        for held, guess, at, cells in (
            (self.held_two, self.guess_two, self.at_two, self.two),
            (self.held_one, self.guess_one, self.at_one, self.one),
        ):
            sure = held & 3
            right = ids == guess
            kept = np.where(right, np.minimum(sure + 1, 3), sure - 1)
            cells[at] = np.where(right | (sure > 1), (guess << 2) | kept, ids << 2 | 1)
        self.before, self.last = self.last, ids

    def size_bounds(self, lanes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.size_ends[lanes, size]
        return start, self.size_ends[lanes, size + 1] - start

    def find_size(self, lanes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By bisection in the ends of the bit lengths."""
        flat, base, low = self.size_ends.reshape(-1), lanes * (_CLASSES + 1), np.zeros(len(lanes), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            ahead = np.minimum(low + step, _CLASSES)
            low = np.where(flat[base + ahead] <= at, ahead, low)
        return low


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0)


class _Writer:
    """Range coder of all lanes: 48-bit low end and range, out by 16-bit words, no carries.

    A range too narrow for the next symbol that goes over a border of words is cut at the
    border. A low end one below it is left as the only value: a range is never empty.
    """

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _MASK, np.uint64)
        self.out, self.used = np.zeros((lanes, words), np.uint16), np.zeros(lanes, np.int64)

    def _emit(self, lanes: np.ndarray) -> None:
        self.out[lanes, self.used[lanes]] = (self.low[lanes] >> _BITS).astype(np.uint16)
        self.used[lanes] += 1
        self.low[lanes] = (self.low[lanes] << _BYTE) & _MASK

    def put(self, lanes: np.ndarray, start: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
        unit = self.range[lanes] // total.astype(np.uint64)
        low = self.low[lanes] + unit * start.astype(np.uint64)
        span = unit * count.astype(np.uint64)
        self.low[lanes], self.range[lanes] = low, span
        while True:
            go = np.flatnonzero(((low ^ (low + span)) >> _BITS == 0) | (span <= _LOW))
            if not len(go):
                return
            lanes, low, span = lanes[go], low[go], span[go]
            tight = (low ^ (low + span)) >> _BITS != 0
            span = np.where(tight, np.maximum(~low & _LOW, _ONE), span) << _BYTE
            self._emit(lanes)
            low = self.low[lanes]
            self.range[lanes] = span

    def finish(self) -> None:
        for _ in range(3):
            self._emit(np.arange(len(self.low)))


class _Reader:
    def __init__(self, blocks: list[np.ndarray]):
        self.words = np.zeros((len(blocks), max(map(len, blocks)) + 4), np.uint16)
        for i, b in enumerate(blocks):
            self.words[i, : len(b)] = b
        self.low, self.range = np.zeros(len(blocks), np.uint64), np.full(len(blocks), _MASK, np.uint64)
        first = self.words[:, :3].astype(np.uint64)
        self.code = first[:, 0] << _BITS | first[:, 1] << _BYTE | first[:, 2]
        self.used = np.full(len(blocks), 3)

    def point(self, lanes: np.ndarray, total: np.ndarray) -> np.ndarray:
        self.unit = self.range[lanes] // total.astype(np.uint64)
        at = (self.code[lanes] - self.low[lanes] & _MASK) // self.unit
        return np.minimum(at.astype(np.int64), total - 1)

    def take(self, lanes: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        low = self.low[lanes] + self.unit * start.astype(np.uint64)
        span = self.unit * count.astype(np.uint64)
        self.low[lanes], self.range[lanes] = low, span
        while True:
            go = np.flatnonzero(((low ^ (low + span)) >> _BITS == 0) | (span <= _LOW))
            if not len(go):
                return
            lanes, low, span = lanes[go], low[go], span[go]
            tight = (low ^ (low + span)) >> _BITS != 0
            span = np.where(tight, np.maximum(~low & _LOW, _ONE), span) << _BYTE
            low = (low << _BYTE) & _MASK
            used = self.used[lanes]
            word = self.words[lanes, np.minimum(used, self.words.shape[1] - 1)].astype(np.uint64)
            self.code[lanes] = (self.code[lanes] << _BYTE) & _MASK | word
            self.low[lanes], self.range[lanes], self.used[lanes] = low, span, used + 1


def pack_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """16-bit words of each block of ids (below 2**31), coded side by side; longest first inside."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    longest = int(sizes[0]) if len(sizes) else 0
    ids = np.zeros((longest, len(blocks)), np.int64)
    for lane, i in enumerate(order):
        ids[: sizes[lane], lane] = blocks[i]
    ids += 1  # 0 is an empty cell of a table
    model, coder = _Lanes(len(blocks)), _Writer(len(blocks), 4 * longest + 8)
    for step in range(longest):
        live = int((sizes > step).sum())
        if live < model.n:
            model.shrink(live)
        now = ids[step, :live]
        model.predict()
        kind = model.kind(now)
        coder.put(model.row, *model.bounds(kind), model.ends[3])
        miss = np.flatnonzero(kind == 2)
        if len(miss):
            value = now[miss]
            size = _bit_length(value)
            coder.put(miss, *model.size_bounds(miss, size), model.size_ends[miss, -1])
            for shift in (16, 0):  # the bits below the highest, at most 16 at a time
                bits = np.clip(size - 1 - shift, 0, 15 if shift else 16)
                wide = np.flatnonzero(bits > 0)
                if len(wide):
                    part = (value[wide] >> shift) & ((1 << bits[wide]) - 1)
                    coder.put(miss[wide], part, np.ones(len(wide), np.int64), 1 << bits[wide])
            model.sizes[miss, size] += 16
        model.learn(now, kind)
    coder.finish()
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    for lane, i in enumerate(order):
        out[i] = coder.out[lane, : coder.used[lane]].copy()
    return out


def unpack_blocks(words: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks of the given sizes: ``pack_blocks`` backwards."""
    if not words:
        return []
    order = sorted(range(len(words)), key=lambda i: -sizes[i])
    counts = np.array([sizes[i] for i in order])
    model, coder = _Lanes(len(words)), _Reader([words[i] for i in order])
    ids = np.zeros((int(counts[0]), len(words)), np.int64)
    for step in range(int(counts[0])):
        live = int((counts > step).sum())
        if live < model.n:
            model.shrink(live)
        model.predict()
        at = coder.point(model.row, model.ends[3])
        kind = (at >= model.ends[1]).astype(np.int64) + (at >= model.ends[2])
        coder.take(model.row, *model.bounds(kind))
        now = np.where(kind == 0, model.guess_two, model.guess_one)
        miss = np.flatnonzero(kind == 2)
        if len(miss):
            size = model.find_size(miss, coder.point(miss, model.size_ends[miss, -1]))
            coder.take(miss, *model.size_bounds(miss, size))
            value = np.where(size > 0, 1 << np.maximum(size - 1, 0), 0)
            for shift in (16, 0):
                bits = np.clip(size - 1 - shift, 0, 15 if shift else 16)
                wide = np.flatnonzero(bits > 0)
                if len(wide):
                    part = coder.point(miss[wide], 1 << bits[wide])
                    coder.take(miss[wide], part, np.ones(len(wide), np.int64))
                    value[wide] |= part << shift
            model.sizes[miss, size] += 16
            now[miss] = value
        model.learn(now, kind)
        ids[step, :live] = now
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
    for lane, i in enumerate(order):
        out[i] = (ids[: sizes[i], lane] - 1).astype(np.uint32)
    return out


def write_file(path: str, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> int:
    """Head, documents, block index and blocks; returns the bytes written."""
    docs = zlib.compress(json.dumps([doc_ids, lengths]).encode(), 1)
    blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    packed = [w for i in range(0, len(blocks), LANES) for w in pack_blocks(blocks[i : i + LANES])]
    index = b"".join(
        struct.pack("<III", len(b), len(w), zlib.crc32(b.astype("<u4").tobytes())) for b, w in zip(blocks, packed)
    )
    parts = [_MAGIC, struct.pack("<QQII", len(docs), len(blocks), zlib.crc32(docs), zlib.crc32(index)), docs, index]
    parts += [w.astype("<u2").tobytes() for w in packed]
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    with fs.open_output_stream(name) as out:
        for p in parts:
            out.write(p)
    return sum(map(len, parts))


def read_file(path: str) -> tuple[list[int | None], list[int], np.ndarray]:
    """Documents, lengths and ids; a damaged part fails."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        if f.read(8) != _MAGIC:
            raise ValueError(f"{path} is no token-id file")
        n_docs, n_blocks, docs_crc, index_crc = struct.unpack("<QQII", f.read(24))
        docs, index = f.read(n_docs), f.read(12 * n_blocks)
        if zlib.crc32(docs) != docs_crc or zlib.crc32(index) != index_crc:
            raise ValueError(f"the head of {path} is damaged")
        doc_ids, lengths = json.loads(zlib.decompress(docs))
        heads = list(struct.iter_unpack("<III", index))
        out = []
        for i in range(0, n_blocks, LANES):
            part = heads[i : i + LANES]
            words = [np.frombuffer(f.read(2 * h[1]), "<u2") for h in part]
            for ids, (_, _, crc) in zip(unpack_blocks(words, [h[0] for h in part]), part):
                if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                    raise ValueError(f"block {len(out)} of {path} is damaged")
                out.append(ids)
    return doc_ids, lengths, np.concatenate(out) if out else np.zeros(0, np.uint32)


class _Pieces(dict):
    """Text behind a space -> its ids, as the tokenizers library cuts " " + text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts are cut at single spaces, where the library starts a word whatever stands around."""
        import re

        cut = [re.split(r"(?<=\S) (?=\S)", t) for t in texts]
        new = list({p for c in cut for p in c[1:]} - self.keys())
        if len(self) + len(new) > 1 << 18:
            self.clear()
            new = list({p for c in cut for p in c[1:]})
        found = self.tok.encode_batch_fast([" " + p for p in new], add_special_tokens=False)
        for p, e in zip(new, found):
            self[p] = np.array(e.ids, "<u4").tobytes()
        firsts = self.tok.encode_batch_fast([c[0] for c in cut], add_special_tokens=False)
        return [
            np.array(e.ids, "<u4").tobytes() + b"".join(map(self.__getitem__, c[1:])) for e, c in zip(firsts, cut)
        ]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the ids of all documents in ascending order of their id; return the stored list of files.

    Null texts are empty; every document ends with ``END_ID``, so none is without ids.
    Null ids come first; rows that share an id are in the order of their texts. Only
    files in the list count: those of lost or repeated tasks are not in it.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0] or 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(max(1, -(-int(size) // part_bytes)), "doc").sortWithinPartitions("doc", "text")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seq = _Pieces(tokenizer), TaskContext.get().partitionId(), 0
        names, lengths, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, lengths, held, size, seq
            ids = np.frombuffer(b"".join(held), "<u4")
            file = f"{path}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tokids"
            row = [part, seq, file, len(ids), write_file(file, names, lengths, ids)]
            names, lengths, held, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        end = struct.pack("<I", END_ID)
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for a in range(0, len(ids), 500):
                for name, raw in zip(ids[a : a + 500], pieces.encode(texts.slice(a, 500).to_pylist())):
                    names.append(name)
                    lengths.append(len(raw) // 4 + 1)
                    held += [raw, end]
                    size += lengths[-1]
                    if size >= LANES * BLOCK_IDS:
                        yield flush()
        if names:
            yield flush()

    return stored(rows.mapInArrow(work, "part int, seq int, file string, n_ids long, n_bytes long"), "token_files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files."""
    ordered = files.withColumn(
        "start", F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    )  # one narrow row for each file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, lengths, ids = read_file(file)
                ends = np.cumsum(np.array(lengths, np.int64))
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(start + ends - np.array(lengths, np.int64)),
                     pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, files.count())
    spread = ordered.select("file", "start").repartition(n)
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_context_mixing_files(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokids")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    files = write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(files)


QUERIES = {"op10_context_mixing_files": op10_context_mixing_files}
ORACLE: dict[str, str] = {}
