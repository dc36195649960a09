"""Operator 7: benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ship, text_or_empty, written
from .text_hash import WORD_CHARACTERS, bounds, buffers, groups, shingle_hashes, word_hashes

WORDS = 5
THRESHOLD = 0.75
#: Shingles of the items that are searched for in one scan of the documents.
#: More items are searched in further scans, block by block.
BLOCK_SHINGLES = 1 << 20


@dataclass
class Block:
    """Items of one scan: ids, shingles, and for each shingle length the sketches."""

    ids: list[int | None]
    shingles: list[np.ndarray]
    sketches: dict[int, tuple[np.ndarray, np.ndarray]]  # length: sorted hashes, their items
    threshold: float


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        words, rows = word_hashes(data, offsets, WORD_CHARACTERS)
        at = bounds(rows, batch.num_rows)
        lengths, hashes = [], []
        for s, e in zip(at[:-1], at[1:], strict=True):
            length = min(WORDS, int(e - s))
            found = shingle_hashes(words[s:e], rows[s:e], length, short=False)[0] if length else words[:0]
            lengths.append(length)
            hashes.append(np.unique(found).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item_id"),
                pa.array(lengths, pa.int32()),
                pa.array([len(h) for h in hashes], pa.int32()),
                pa.array(hashes, pa.list_(pa.int64())),
            ],
            names=["item_id", "length", "n", "hashes"],
        )


def sketch_size(n: int, threshold: float) -> int:
    """Smallest hashes kept of an item of ``n`` shingles.

    Items are partitioned by the power of two below their size; the partition's
    upper bound u sets the sketch: with floor((1 - threshold) * u) + 1 of its
    shingles, no document that holds the threshold's share can miss them all.
    """
    upper = (1 << n.bit_length()) - 1
    return min(n, int((1 - threshold) * upper) + 1)


def item_blocks(
    items: DataFrame, threshold: float = THRESHOLD, item_id_col: str = "item_id", text_col: str = "text"
) -> Iterator[Block]:
    """The items with a word, in blocks of a bounded number of shingles."""
    ship(items.sparkSession)
    rows = pick(items, item_id=item_id_col, text=text_col).select(
        F.col("item_id").cast("long"), text_or_empty("text").alias("text")
    )
    sized = written(
        rows.mapInArrow(_item_shingles, "item_id long, length int, n int, hashes array<long>").where("n > 0"),
        "items",
    )
    total = sized.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-2 * total // BLOCK_SHINGLES) if total > BLOCK_SHINGLES else 1
    for b in range(n_blocks if total else 0):
        part = sized
        if n_blocks > 1:
            part = sized.where(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(n_blocks)) == b)
        found = part.collect()  # about BLOCK_SHINGLES hashes at most
        shingles = [np.array(r["hashes"], np.int64).view(np.uint64) for r in found]
        sketches = {}
        for length in {r["length"] for r in found}:
            at = [i for i, r in enumerate(found) if r["length"] == length]
            parts = [shingles[i][: sketch_size(len(shingles[i]), threshold)] for i in at]
            hashes, owners = np.concatenate(parts), np.repeat(at, [len(p) for p in parts])
            order = np.argsort(hashes, kind="stable")
            sketches[length] = hashes[order], owners[order]
        yield Block([r["item_id"] for r in found], shingles, sketches, threshold)


def _matches(block: Block, column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of every item that a text contains to the threshold."""
    tables = {}
    for length, (hashes, _) in block.sketches.items():
        bits = max(16, (16 * len(hashes)).bit_length())
        table = np.zeros(1 << bits, bool)
        table[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        tables[length] = table, np.uint64(64 - bits)
    data, offsets = buffers(column)
    for i, j in groups(offsets):
        words, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORD_CHARACTERS)
        for length, (sketch, owners) in block.sketches.items():
            table, shift = tables[length]
            hashes, at = shingle_hashes(words, rows, length, short=False)
            maybe = np.flatnonzero(table[(hashes >> shift).astype(np.int64)])
            low = np.searchsorted(sketch, hashes[maybe], "left")
            high = np.searchsorted(sketch, hashes[maybe], "right")
            pairs = {
                (int(row), int(k))
                for row, s, e in zip(at[maybe], low, high, strict=True)
                for k in owners[s:e]
            }
            starts, row, own = bounds(at, j - i), None, None
            for r, k in sorted(pairs):
                if r != row:
                    row, own = r, np.unique(hashes[starts[r] : starts[r + 1]])
                item = block.shingles[k]
                where = np.minimum(np.searchsorted(own, item), len(own) - 1)
                shared = int((own[where] == item).sum())
                if shared >= block.threshold * len(item):
                    yield i + r, k, shared


def _search(shared_block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared_block.value
        for batch in batches:
            ids = batch.column("doc_id")
            found = list(_matches(block, batch.column("text")))
            sizes = [len(block.shingles[k]) for _, k, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([r for r, _, _ in found], pa.int64())),
                    pa.array([block.ids[k] for _, k, _ in found], pa.int64()),
                    pa.array([n for _, _, n in found], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([n / m for (_, _, n), m in zip(found, sizes, strict=True)], pa.float64()),
                ],
                names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
            )

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): the items that documents contain.

    Words are runs of letters, digits and non-ASCII after lower-casing A-Z. An
    item's shingles are its five-word runs (of all its words, if it has
    fewer). Its sketch is the bottom of one MinHash permutation, as long as
    its size partition needs; a document becomes a candidate for an item by
    holding any hash of the sketch, wherever in the text, and is then checked
    on the item's whole shingle set. So long documents don't dilute short
    items, and nothing at or over the threshold is missed.

    The documents are read once for each block of items and never shuffled.

    Nulls and empties: null or empty texts and items match nothing; null ids
    are carried along. Repeated documents and items each give their rows. An
    empty table gives no rows. Other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), text_or_empty("text").alias("text")
    )
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, threshold, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.unionByName(rows.mapInArrow(_search(shared), schema))
    return out


def _clean(shared_block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, _, _ in _matches(shared_block.value, batch.column("_text"))]] = False
            yield batch.drop_columns(["_text"]).filter(pa.array(keep))

    return run


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that contain an item; see ``contaminated``."""
    out = docs
    for block in item_blocks(items, threshold, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        names, schema = out.columns, out.schema
        at = f"_{names.index(text_col)}"
        rows = out.toDF(*[f"_{i}" for i in range(len(names))])
        inner = rows.schema
        rows = rows.withColumn("_text", text_or_empty(at))
        out = rows.mapInArrow(_clean(shared), inner).toDF(*names)
        assert out.columns == schema.names
    return out
