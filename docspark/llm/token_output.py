"""Operator 8: token ids in patched frame-of-reference blocks.

File format. A token file is the run of segments with one ``file`` number, in
``segment`` order; the documents of all files together are in ascending id
order. Spark writes the segments as rows of a Parquet table, so that any store
Spark writes to will do and a lost task is simply run again. A segment holds
whole documents, about ``SEGMENT_TOKENS`` ids, as bytes (little-endian):

    magic "PFB1", n_values u32, block_size u32, n_blocks u32,
    per block: minimum u32, width u8, n_exceptions u16, start u32,
    packed blocks, exception positions u16, exception values u32

A block's values less its minimum are packed at the width that holds the
``PERCENTILE``-th of them; the rest are exceptions, packed as 0 and listed with
their position in the block. ``start`` is the block's offset into the packed
bytes, so one block can be read alone (``read_block``).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, ship, text_or_empty, written
from .text_hash import buffers, groups

BLOCK = 256
PERCENTILE = 95
SEGMENT_TOKENS = 1 << 16
_HEAD = struct.Struct("<4sIII")


def _widths(deltas: np.ndarray) -> np.ndarray:
    at = -(-deltas.shape[1] * PERCENTILE // 100) - 1
    top = np.partition(deltas, at, axis=1)[:, at]
    return np.frexp(top.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of values below 2**w, packed to bytes, the lowest bit first; 64 values make w whole words."""
    columns = np.ascontiguousarray(values.astype(np.uint64).reshape(-1, 64).T)
    words = np.zeros((w, columns.shape[1]), np.uint64)
    for j, column in enumerate(columns):
        k, shift = divmod(j * w, 64)
        words[k] |= column << np.uint64(shift)
        if shift + w > 64:
            words[k + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8).reshape(len(values), -1)


def _unpack(rows: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(rows).view("<u8").reshape(-1, w).T).astype(np.uint64, copy=False)
    columns = np.empty((64, words.shape[1]), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for j, column in enumerate(columns):
        k, shift = divmod(j * w, 64)
        np.right_shift(words[k], np.uint64(shift), out=column)
        if shift + w > 64:
            column |= words[k + 1] << np.uint64(64 - shift)
        column &= mask
    return columns.T.reshape(len(rows), -1)


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of these unsigned 32-bit values."""
    if block % 64:
        raise ValueError("a block must hold a multiple of 64 values")
    n, n_blocks = len(values), -(-len(values) // block)
    if n == 0:
        return _HEAD.pack(b"PFB1", 0, block, 0)
    padded = np.concatenate([values, np.full(n_blocks * block - n, values[-1])]).astype(np.uint32)
    grid = padded.reshape(n_blocks, block)
    low = grid.min(1)
    deltas = grid - low[:, None]
    widths = _widths(deltas)
    over = deltas >> widths[:, None].astype(np.uint32) > 0
    where = np.flatnonzero(over)
    exceptions = deltas.reshape(-1)[where]
    deltas[over] = 0
    sizes = widths.astype(np.int64) * block // 8
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(widths):
        if w:
            of = np.flatnonzero(widths == w)
            rows = _pack(deltas[of], int(w))
            packed[starts[of][:, None] + np.arange(rows.shape[1])] = rows
    return b"".join(
        [
            _HEAD.pack(b"PFB1", n, block, n_blocks),
            low.astype("<u4").tobytes(),
            widths.tobytes(),
            over.sum(1).astype("<u2").tobytes(),
            starts[:-1].astype("<u4").tobytes(),
            packed.tobytes(),
            (where % block).astype("<u2").tobytes(),
            exceptions.astype("<u4").tobytes(),
        ]
    )


def _parts(data: bytes):
    magic, n, block, n_blocks = _HEAD.unpack_from(data)
    if magic != b"PFB1":
        raise ValueError("not a segment of token ids")
    at, out = _HEAD.size, []
    for kind in ("<u4", "u1", "<u2", "<u4"):
        column = np.frombuffer(data, kind, n_blocks, at)
        out.append(column.astype(np.int64))
        at += column.nbytes
    return n, block, n_blocks, at, out


def decode(data: bytes) -> np.ndarray:
    """The values of a segment."""
    n, block, n_blocks, at, (low, widths, counts, starts) = _parts(data)
    grid = np.zeros((n_blocks, block), np.int64)
    packed_size = int((widths * block // 8).sum())
    packed = np.frombuffer(data, np.uint8, packed_size, at)
    for w in np.unique(widths):
        if w:
            of = np.flatnonzero(widths == w)
            grid[of] = _unpack(packed[starts[of][:, None] + np.arange(w * block // 8)], int(w))
    at += packed_size
    total = int(counts.sum())
    where = np.frombuffer(data, "<u2", total, at).astype(np.int64)
    grid[np.repeat(np.arange(n_blocks), counts), where] = np.frombuffer(data, "<u4", total, at + 2 * total)
    return (grid + low[:, None]).reshape(-1)[:n].astype("<u4")


def read_block(data: bytes, k: int) -> np.ndarray:
    """The values of block ``k`` alone, found by the block starts."""
    n, block, n_blocks, at, (low, widths, counts, starts) = _parts(data)
    w, size = int(widths[k]), int(widths[k]) * block // 8
    out = np.zeros(block, np.int64)
    if w:
        rows = np.frombuffer(data, np.uint8, size, at + int(starts[k]))
        out = np.unpackbits(rows, bitorder="little").reshape(block, w) @ (1 << np.arange(w))
    at += int((widths * block // 8).sum())
    total, before, here = int(counts.sum()), int(counts[:k].sum()), int(counts[k])
    where = np.frombuffer(data, "<u2", here, at + 2 * before)
    out[where] = np.frombuffer(data, "<u4", here, at + 2 * total + 4 * before)
    return (out + low[k])[: min(block, n - k * block)].astype("<u4")


#: Marks that pre-tokenization cuts from a letter before them and keeps together up to the next space.
_TAIL = ".,!?;:%$&#*"
_TAILS = 1 << 12
_IS_TAIL = np.isin(np.arange(256), list(_TAIL.encode()))
_IS_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: When a worker remembers more bytes of words, their ids and the offsets of both, the half met least often goes.
REMEMBERED_BYTES = 16 << 20
#: Bytes of text encoded at once, one text at least.
AT_ONCE = 4 << 20
#: Words given to the library as one text.
_RUN = 256
_workers: dict[str, "_Encoder"] = {}


def _ends_in_letter(words: pa.Array) -> np.ndarray:
    """Whether a string's last character is one of A-Z, a-z and the letters from U+00C0 to U+00FF."""
    data, offsets = buffers(words)
    size = np.diff(offsets)
    data = np.append(np.zeros(2, np.uint8), data)
    last, before = data[offsets[1:] + 1], data[offsets[1:]]
    return (size > 0) & (_IS_LETTER[last] | (size > 1) & (before == 0xC3) & (last != 0x97) & (last != 0xB7))


def _bytes_of(ids: list[list[int]]) -> pa.Array:
    """Each list's ids as bytes."""
    flat = np.fromiter(chain.from_iterable(ids), "<u4", sum(map(len, ids)))
    return _cut(flat, np.cumsum([0, *map(len, ids)]))


def _cut(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(4 * at.astype(np.int64)), pa.py_buffer(ids)]
    )


class _Encoder:
    """Ids by the tokenizers library, each distinct word once as long as it is remembered.

    Byte-level pre-tokenization always cuts before a single space between two
    other characters, and between a letter and marks after it; merges never
    cross a cut. So a text's ids are the ids of the pieces between such spaces,
    one after the other, and a piece's are those of the word and of the marks
    at its end. The library's defaults hold: the string of a special token in a
    text gives its id, with a space before it as a piece of its own; it holds
    no space and none of the marks, so no cut parts it.

    Words and ids are Arrow arrays, of a few bytes an entry beside their own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.opens = np.array([t.startswith("\u0120") for t in tokens])  # how byte-level tokens write a space
        self.words = pa.array([], pa.large_string())  # each follows a space
        self.ids = pa.array([], pa.large_binary())
        self.met = np.zeros(0, np.int64)  # how often each word was met
        self.tails: dict[str, list[int]] = {}

    @staticmethod
    def _pieces(texts: pa.Array) -> pa.Array:
        """Each text's pieces. A space is a cut if no other white space stands beside it."""
        lists = pc.split_pattern(texts, " ").cast(pa.large_list(pa.large_string()))
        flat, size = lists.flatten(), lists.value_lengths().to_numpy()
        inner = np.diff(buffers(pc.utf8_trim_whitespace(flat))[1])
        beside = (inner == 0) | (inner < np.diff(buffers(flat)[1]))
        odd = np.add.reduceat(beside, np.cumsum(size) - size, dtype=np.int64) > 0
        odd &= size > 1
        if not odd.any():
            return lists
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        rest = pa.array([_LONE_SPACE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], lists.type)
        return pa.concat_arrays([lists.filter(pa.array(~odd)), rest]).take(pa.array(np.argsort(order)))

    def _encode(self, new: pa.Array) -> pa.Array:
        """Ids of words that follow a space. Plain ones are encoded many at a time, as one text.

        A plain word has no space in it, so its first id is the next one
        whose token begins with a space.
        """
        inner = np.diff(buffers(pc.utf8_trim_whitespace(new))[1])
        plain = (inner > 0) & (inner == np.diff(buffers(new)[1])) & ~pc.match_substring(new, " ").to_numpy(zero_copy_only=False)
        words = new.filter(pa.array(plain))
        at = pa.array(np.append(np.arange(0, len(words), _RUN), len(words)), pa.int32())
        runs = pc.binary_join(pa.ListArray.from_arrays(at, words), pa.scalar(" ", pa.large_string()))
        found = self.tokenizer.encode_batch_fast([" " + r for r in runs.to_pylist()], add_special_tokens=False)
        lists = [x.ids for x in found]
        ids = np.fromiter(chain.from_iterable(lists), "<u4", sum(map(len, lists)))
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):
            raise ValueError("the tokenizer does not cut before single spaces")
        out = _cut(ids, np.append(starts, len(ids)))
        if len(words) == len(new):
            return out
        odd = [" " + p for p in new.filter(pa.array(~plain)).to_pylist()]
        found = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        return pa.concat_arrays([out, _bytes_of([x.ids for x in found])]).take(pa.array(np.argsort(order)))

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Where each of these words, which follow a space, stands among the remembered ones."""
        size = self.words.nbytes + self.ids.nbytes
        if size > REMEMBERED_BYTES:
            keep = self.met > np.median(self.met)  # half of them at most
            self.words, self.ids = self.words.filter(pa.array(keep)), self.ids.filter(pa.array(keep))
            self.met = self.met[keep] // 2
        found = pc.index_in(words, value_set=self.words)
        rows = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            missing = np.flatnonzero(rows < 0)
            new = words.take(pa.array(missing)).dictionary_encode()
            rows[missing] = len(self.words) + new.indices.to_numpy()
            self.ids = pa.concat_arrays([self.ids, self._encode(new.dictionary)])
            self.words = pa.concat_arrays([self.words, new.dictionary])
        met = np.bincount(rows, minlength=len(self.words))
        met[: len(self.met)] += self.met
        self.met = met
        return rows

    def _parted(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, pa.DictionaryArray]:
        """The pieces without marks after a last letter; where there were some; those marks."""
        data, offsets = buffers(pieces)
        parted = np.zeros(len(pieces), bool)
        full = np.flatnonzero(np.diff(offsets))
        parted[full] = _IS_TAIL[data[offsets[full + 1] - 1]]
        stems = pc.utf8_rtrim(pieces.filter(pa.array(parted)), _TAIL)
        fit = _ends_in_letter(stems)
        parted[parted] = fit
        stems = stems.filter(pa.array(fit))
        size = np.diff(offsets)[parted] - np.diff(buffers(stems)[1])
        ends = np.cumsum(size)
        place = np.repeat(offsets[1:][parted] - ends, size) + np.arange(ends[-1] if len(ends) else 0)
        offsets, marks = np.append(0, ends).astype(np.int64), data[place]
        tails = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(marks))
        return pc.replace_with_mask(pieces, pa.array(parted), stems), parted, tails.dictionary_encode()

    def _tail(self, tail: str) -> list[int]:
        if len(self.tails) > _TAILS:
            self.tails.clear()
        if tail not in self.tails:
            self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
        return self.tails[tail]

    def __call__(self, texts: pa.Array | list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after the other, each text's with ``end`` after them, and how many each has."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        lists = self._pieces(texts)
        size, flat = lists.value_lengths().to_numpy(), lists.flatten()
        last = np.cumsum(size) - 1
        at_first = np.zeros(len(flat), bool)
        at_first[last + 1 - size] = True
        words, parted, tails = self._parted(flat.filter(pa.array(~at_first)))
        rows = self._rows(words)
        opening = self.tokenizer.encode_batch_fast(flat.filter(pa.array(at_first)).to_pylist(), add_special_tokens=False)
        marks = [self._tail(t) for t in tails.dictionary.to_pylist()]
        parts = [self.ids, _bytes_of(marks), _bytes_of([x.ids for x in opening]), pa.array([end], pa.large_binary())]
        begin = np.cumsum([0, *map(len, parts)])
        # what each piece gives: its own ids, those of its marks, the end of a text
        gives = np.ones(len(flat), np.int64)
        with_marks = np.flatnonzero(~at_first)[parted]
        gives[with_marks] += 1
        gives[last] += 1
        at = np.cumsum(gives) - gives
        which = np.empty(int(gives.sum()), np.int64)
        which[at[at_first]] = begin[2] + np.arange(len(texts))
        which[at[~at_first]] = rows
        which[at[with_marks] + 1] = begin[1] + tails.indices.to_numpy()
        which[at[last] + gives[last] - 1] = begin[3]
        data, offsets = buffers(pa.concat_arrays(parts).take(pa.array(which)))
        return data.view("<u4"), np.diff(offsets[np.append(at[at_first], len(which))]) // 4


_SEGMENT_SCHEMA = (
    "file int, segment int, first_token long, n_tokens long,"
    " doc_ids array<long>, doc_tokens array<long>, payload binary"
)


def _segments(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer_path not in _workers:
            _workers[tokenizer_path] = _Encoder(tokenizer_path)
        encoder, file = _workers[tokenizer_path], TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        ids, counts, parts, segment, first, size = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, parts, segment, first, size
            columns = [[file], [segment], [first], [size], [ids], [counts], [encode(np.concatenate(parts))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["file", "segment", "first_token", "n_tokens", "doc_ids", "doc_tokens", "payload"]
            ids, counts, parts, segment, first, size = [], [], [], segment + 1, first + size, 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for i, j in groups(buffers(batch.column(1))[1], AT_ONCE):
                part = batch.slice(i, j - i)
                found, lengths = encoder(part.column(1), end)
                at = 0
                for doc, n in zip(part.column(0).to_pylist(), lengths.tolist(), strict=True):
                    ids.append(doc)
                    counts.append(n)
                    parts.append(found[at : at + n])
                    at += n
                    size += n
                    if size >= SEGMENT_TOKENS:
                        yield flush()
        if ids:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents' ids, in ascending order of the document's id; the segments, read back.

    The texts are shuffled once, by range of (id, hash of the text), so that
    files are balanced even if an id repeats. Each task tokenizes its range
    and packs segments as it goes; it holds one segment at a time.
    """
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), text_or_empty("text").alias("text")
    )
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    return written(
        ranged.select("doc_id", "text").mapInArrow(_segments(tokenizer_path, end_id), _SEGMENT_SCHEMA),
        "token_segments",
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "doc_id", "first", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            data = decode(row["payload"]).tobytes()
            counts = np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(counts)
            if len(data) != 4 * row["n_tokens"] or ends[-1] != row["n_tokens"]:
                raise ValueError("a segment's ids and its documents don't agree")
            crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["file"]] * len(counts), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first_token"] + ends - counts),
                    pa.array(counts),
                    pa.array(crc, pa.int64()),
                ],
                names=names,
            )


def read_token_index(segments: DataFrame) -> DataFrame:
    """Each document's place among all ids, from the decoded files.

    Returns doc_id, start, n_tokens (with the end id), ids_crc32.
    """
    ship(segments.sparkSession)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # a row per file
    offsets = offsets.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    schema = "file int, doc_id long, first long, n_tokens long, ids_crc32 long"
    docs = segments.select("file", "first_token", "n_tokens", "doc_ids", "doc_tokens", "payload")
    return (
        docs.mapInArrow(_documents, schema)
        .join(F.broadcast(offsets), "file")
        .select("doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0, **columns: str) -> DataFrame:
    """Tokenize, write and read back: doc_id, start, n_tokens, ids_crc32 per document.

    Nulls and empties: a null or empty text has only its end id; null ids come
    first. Documents with one id are written one after the other, in the order
    of their text's hash. An empty table gives no rows. Other columns are
    ignored.
    """
    return read_token_index(write_token_files(docs, tokenizer_path, end_id, **columns))
