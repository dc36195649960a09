"""Operator 1: remove long repeated byte strings, by prefix-free parsing.

Rolling-hash triggers cut every text into phrases. A trigger is the window of
``GRAM`` bytes with the smallest rolling hash among all windows inside a string
of ``min_bytes``; so it depends on that string alone, and equal strings have
their trigger at the same offset. The neighbouring strings that share a trigger
are one phrase: a run of starts, with the bytes they cover.

The dictionary holds each distinct phrase once, with its number of
occurrences in the parse. Two suffixes of the corpus agree on their first
``min_bytes`` bytes exactly if they stand at the same offset from triggers and
the bytes agree; in a suffix array they would be neighbours. As only this
equality counts here, not which suffix is smaller, dictionary and parse are
ordered by 128-bit names (hashes of content) instead of by bytes, and three
rounds of ever shorter phrases are combined:

1. whole phrases: two with one name make all their starts repeats; a phrase
   whose trigger occurs nowhere else has none;
2. blocks of ``BLOCK`` starts of the phrases left over, at fixed offsets from
   the trigger: repeated as a whole, or unique in the bytes that all their
   strings share, or neither;
3. single starts of the blocks left over.

Each round names, counts and joins; counting combines on the map side and a
hot name never gathers its occurrences in one task. From one round to the next
goes one occurrence of each distinct phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, pick, ship, text_or_empty, written, written_by_key
from .text_hash import _BYTE_VALUES, _power, buffers, mix

MIN_BYTES = 400
GRAM = 128
BLOCK = 32
#: Starts handled at once, and the bits that hold a place among them.
CHUNK = 1 << 20
_PLACE = 22

_NAMED = "kd long, th long, first int, n int, trigger int, key long, s1 long, s2 long"


def _triggers(data: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start p in ``data`` the place of its string's trigger; the rolling hashes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    part = _BYTE_VALUES[data]
    part *= _power("up", n)
    np.cumsum(part, out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * _power("down", n - gram + 1))
    low = np.uint64((1 << _PLACE) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, size = min_bytes - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least & low).astype(np.int64), hashes


def _names(data: memoryview, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    name = xxhash.xxh3_128_digest
    parts = [name(data[s:e], seed=k) for s, e, k in zip(starts.tolist(), ends.tolist(), seeds.tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


def _batch(kd, th, first, n, trigger, key, names) -> pa.RecordBatch:
    columns = [
        *(pa.array(x, pa.int64()) for x in (kd, th)),
        *(pa.array(x.astype(np.int32)) for x in (first, n, trigger)),
        *(pa.array(np.ascontiguousarray(x)) for x in (key, names[:, 0], names[:, 1])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["kd", "th", "first", "n", "trigger", "key", "s1", "s2"])


def _phrases(min_bytes: int, gram: int):
    """The phrases of whole texts; key is the hash of the trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kd, th = (batch.column(c).to_numpy() for c in ("kd", "th"))
            data, offsets = buffers(batch.column("text"))
            view = memoryview(data)
            for low in range(0, len(data) - min_bytes + 1, CHUNK):
                high = min(len(data), low + CHUNK + min_bytes - 1)
                at, hashes = _triggers(data[low:high], min_bytes, gram)
                starts = np.arange(low, low + len(at))
                doc = np.searchsorted(offsets, starts, "right") - 1
                fits = np.flatnonzero(starts + min_bytes <= offsets[doc + 1])
                if not len(fits):
                    continue
                new = np.ones(len(fits), bool)
                new[1:] = (np.diff(fits) > 1) | (np.diff(at[fits]) != 0)
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(fits)))
                first, trigger, doc = starts[fits[begin]], at[fits[begin]] + low, doc[fits[begin]]
                back = trigger - first
                names = _names(view, first, first + n - 1 + min_bytes, back * min_bytes + n)
                key = hashes[at[fits[begin]]].view(np.int64)
                begin_of_doc = offsets[doc]
                yield _batch(kd[doc], th[doc], first - begin_of_doc, n, trigger - begin_of_doc, key, names)

    return run


def _blocks(min_bytes: int):
    """Blocks of starts of given phrases; key names the bytes that all strings of a block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            view = memoryview(data)
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kd", "th", "phrases")), strict=True)):
                first, n, trigger = np.array([[p["first"], p["n"], p["trigger"]] for p in row[2]], np.int64).T
                near, far = trigger - first - n + 1, trigger - first  # distances to the trigger
                count = far // BLOCK - near // BLOCK + 1
                of = np.repeat(np.arange(len(first)), count)
                k = near[of] // BLOCK + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                near, far = np.maximum(near[of], k * BLOCK), np.minimum(far[of], k * BLOCK + BLOCK - 1)
                here = trigger[of] + offsets[i]
                shared = _names(view, here - k * BLOCK, here - (k + 1) * BLOCK + 1 + min_bytes, k)
                names = _names(view, here - far, here - near + min_bytes, far * min_bytes + near)
                size = len(of)
                yield _batch(
                    [row[0]] * size, [row[1]] * size, trigger[of] - far, far - near + 1, trigger[of],
                    shared[:, 0], names,
                )

    return run


def _starts(min_bytes: int):
    """The single starts of given phrases; key is the name itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            view = memoryview(data)
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kd", "th", "phrases")), strict=True)):
                at = np.concatenate([np.arange(p["first"], p["first"] + p["n"]) for p in row[2]])
                here, one = at + offsets[i], np.ones(len(at), np.int64)
                names = _names(view, here, here + min_bytes, one)
                yield _batch([row[0]] * len(at), [row[1]] * len(at), at, one, at, names[:, 0], names)

    return run


def _resolved(named: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The phrases that repeat as a whole; one occurrence of each that the next round must see; the latter's table.

    The keys that occur twice are a table by themselves, so that adaptive
    execution can split the join with a hot one.
    """
    keys = named.groupBy("key").agg(F.count("*").alias("k"), F.min("s1").alias("x"), F.max("s1").alias("y"))
    keys = written(keys.where("k > 1").select("key", (F.col("x") != F.col("y")).alias("several")), "repeated_keys")
    shared = written(named.join(keys, "key"), "shared_phrases")
    dropped(keys)
    counted = shared.groupBy("key", "s1", "s2", "several").agg(
        F.count("*").alias("k"), *[F.first(c).alias(c) for c in ("kd", "th", "first", "n", "trigger")]
    )
    dictionary = written(counted, "dictionary")
    repeats = shared.join(dictionary.where("k > 1").select("key", "s1", "s2"), ["key", "s1", "s2"], "left_semi")
    repeats = written(repeats.select("kd", "th", "first", "n"), "repeats")
    dropped(shared)
    if last:
        return repeats, None, dictionary
    return repeats, dictionary.where("several").select("kd", "th", "first", "n", "trigger"), dictionary


def _with_texts(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    listed = phrases.groupBy("kd", "th").agg(F.collect_list(F.struct("first", "n", "trigger")).alias("phrases"))
    return texts.select("kd", "th", "text").join(listed, ["kd", "th"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        out = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            runs: list[list[int]] = []
            for span in sorted((s["start"], s["end"]) for s in spans or ()):
                if runs and span[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span[1])
                else:
                    runs.append(list(span))
            kept, at = [], 0
            for start, end in runs:
                kept.append(text[at:start])
                at = end
            kept = b"".join([*kept, text[at:]])
            out.append((len(text), len(text) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest()))
        size, removed, runs, kept, sha = zip(*out, strict=True) if out else ([],) * 5
        runs = [[{"start": s, "end": e} for s, e in r] for r in runs]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("copies"),
                pa.array(size, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(runs, kind),
                pa.array(kept, pa.binary()),
                pa.array(sha, pa.string()),
            ],
            names=["doc_id", "copies", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
        )


_REMOVED = (
    "doc_id long, copies long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>,"
    " kept binary, kept_sha256 string"
)


def suffix_dedup(
    docs: DataFrame,
    min_bytes: int = MIN_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_bytes: bool = True,
) -> DataFrame:
    """Each document without the bytes that a repeated string of ``min_bytes`` bytes covers.

    Texts are UTF-8 bytes; strings stay inside one document and may overlap;
    all are judged on the input. See the module's text for the method. Only
    documents with a repeated trigger have their text shuffled.

    Nulls and empties: a null text counts as empty; texts shorter than
    ``min_bytes`` stay whole. Null ids are carried along. Repeated rows repeat
    each other's text, so both lose it. An empty table gives no rows. Other
    columns are ignored.

    Returns doc_id, n_bytes, n_removed, spans, kept (binary; left out without
    ``keep_bytes``, which saves a shuffle of unaffected texts), kept_sha256.
    """
    if min_bytes < BLOCK + 8:
        raise ValueError("min_bytes is too small")
    ship(docs.sparkSession)
    gram = min(GRAM, min_bytes // 2)
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), text_or_empty("text").alias("text")
    )
    rows = rows.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("kd"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("th"),
        "text",
    )
    parse = written(rows.select("kd", "th", "text").mapInArrow(_phrases(min_bytes, gram), _NAMED), "parse")
    repeats, open_phrases, dictionary = _resolved(parse)
    dropped(parse)
    spans = [repeats]
    touched = written(repeats.select("kd", "th").unionByName(open_phrases.select("kd", "th")).distinct(), "touched")
    texts = rows.join(touched, ["kd", "th"], "left_semi").groupBy("kd", "th")
    texts = texts.agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = written_by_key(texts, ["kd", "th"], "touched_texts")
    for step, last in ((_blocks, False), (_starts, True)):
        named = written(_with_texts(texts, open_phrases).mapInArrow(step(min_bytes), _NAMED), "named")
        dropped(dictionary)
        repeats, open_phrases, dictionary = _resolved(named, last)
        dropped(named)
        spans.append(repeats)
    dropped(dictionary)
    found = spans[0].unionByName(spans[1]).unionByName(spans[2])
    found = found.groupBy("kd", "th").agg(
        F.collect_list(
            F.struct(
                F.col("first").cast("long").alias("start"),
                (F.col("first") + F.col("n") - 1 + min_bytes).cast("long").alias("end"),
            )
        ).alias("spans")
    )
    columns = ["doc_id", "n_bytes", "n_removed", "spans", *["kept"] * keep_bytes, "kept_sha256"]
    changed = texts.join(found, ["kd", "th"], "left").select("doc_id", "copies", "text", "spans")
    changed = changed.mapInArrow(_removed, _REMOVED)
    changed = changed.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
    whole = rows.select(
        "kd",
        "th",
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start: long, end: long>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
    if not keep_bytes:
        whole = whole.drop("kept")
    return changed.unionByName(whole.join(touched, ["kd", "th"], "left_anti").select(*columns))
