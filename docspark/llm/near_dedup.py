"""Operator 9: near-duplicate classes by HyperMinHash sketches, banding and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counted, dropped, pick, ship, text_or_empty, written
from .text_hash import NOT_SPACE, bounds, buffers, groups, mix, shingle_hashes, word_hashes

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: 32 bands of 4 registers: a pair at similarity 0.75 is missed by every band
#: with probability (1 - 0.75**4)**32, about 5e-6.
ROWS_PER_BAND = 4
BANDS = BUCKETS // ROWS_PER_BAND
#: Sets of fewer shingles get as many bands again, of other registers, since theirs depend on each other.
SMALL = 2 * BUCKETS
EMPTY = 0xFFFF
#: Two different minima give the same register about this often.
COLLISION = 2.0**-MANTISSA_BITS / 3
#: Candidates stay if their estimate is within so many standard errors of the threshold.
SIGMAS = 5.0
#: Groups with so many members at most beside their largest component are compared in tasks; others get hubs.
#: Both ways are exact.
TOGETHER = 256


def registers(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """HyperMinHash registers of ``n_rows`` sets.

    ``hashes`` are sorted inside each row, so the first in a bucket (the top
    bits) is its minimum. A register holds the minimum's count of leading
    zeros and the mantissa bits that follow its leading one.
    """
    out = np.full((n_rows, BUCKETS), EMPTY, np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (rows[1:] != rows[:-1])
    # 53 bits, so that a float holds them exactly
    value = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    shift = np.maximum(length - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    mantissa = (value >> shift).astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    out[rows[first], bucket[first]] = ((53 - length) << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs [i, j) of rows: their sorted distinct shingle hashes and the row (from 0) of each."""
    data, offsets = buffers(column)
    for i, j in groups(offsets):
        words, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
        hashes, rows = shingle_hashes(words, rows, WORDS)
        at = bounds(rows, j - i)
        for s, e in zip(at[:-1], at[1:], strict=True):
            hashes[s:e].sort()
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        yield i, j, hashes[new], rows[new]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, hashes, rows in shingle_sets(batch.column("text")):
            n, at = j - i, bounds(rows, j - i)
            sums = np.zeros((2, n), np.uint64)
            some = np.flatnonzero(at[1:] > at[:-1])
            if len(some):
                sums[0, some] = np.add.reduceat(hashes, at[some])
                sums[1, some] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at[some])
            sketch = registers(hashes, rows, n).tobytes()
            size = BUCKETS * 2
            part = batch.slice(i, n)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.array([sketch[k * size : (k + 1) * size] for k in range(n)], pa.binary()),
                ],
                names=[*part.schema.names, "n_shingles", "h1", "h2", "registers"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(buffers(column)[0], np.uint16).reshape(len(column), BUCKETS)


def densified(found: np.ndarray) -> np.ndarray:
    """Registers whose empty buckets take the register of a bucket drawn for them.

    The draws are the same for all sets. So small sets, which leave most
    buckets empty, agree in a register with their similarity, too, and do not
    meet in a band over one shared shingle.
    """
    out = found.copy()
    row, bucket = np.nonzero(found == EMPTY)
    some = (found != EMPTY).any(1)
    row, bucket = row[some[row]], bucket[some[row]]
    attempt = 0
    while len(row):
        attempt += 1
        drawn = mix((bucket.astype(np.uint64) << np.uint64(32)) + np.uint64(attempt)) >> np.uint64(64 - BUCKET_BITS)
        value = found[row, drawn.astype(np.int64)]
        full = value != EMPTY
        out[row[full], bucket[full]] = value[full]
        row, bucket = row[~full], bucket[~full]
    return out


#: Which registers make up each band: all in turn, then, for small sets, in another order.
_ORDER = np.argsort(mix(np.arange(BUCKETS, dtype=np.uint64)))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))
    for batch in batches:
        dense = densified(_matrix(batch.column("registers")))
        both = np.concatenate([dense, dense[:, _ORDER]], axis=1)
        keys = mix(np.ascontiguousarray(both).view(np.uint64) ^ salt)
        sizes = batch.column("n_shingles").to_numpy()
        emit = np.ones(keys.shape, bool)
        emit[sizes >= SMALL, BANDS:] = False
        row = np.nonzero(emit)[0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[emit].view(np.int64)),
                pa.array(batch.column("cid").to_numpy()[row]),
            ],
            names=["band", "cid"],
        )


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the buckets in use."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    raw = equal / np.maximum(used, 1)
    return (raw - COLLISION) / (1 - COLLISION), used


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = PERCENT / 100
    for batch in batches:
        guess, used = estimate(_matrix(batch.column("registers_a")), _matrix(batch.column("registers_b")))
        keep = guess >= least - SIGMAS * np.sqrt(least * (1 - least) / np.maximum(used, 1))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets(column: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    out = []
    for i, j, hashes, rows in shingle_sets(column):
        at = bounds(rows, j - i)
        out += [hashes[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
    return out


def _hub_sets(hubs: pa.Array, texts: pa.Array) -> list[np.ndarray]:
    """``_sets`` of ``texts``, where neighbouring rows with one hub share one array."""
    ids = hubs.to_numpy()
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    found = _sets(texts.take(pa.array(np.flatnonzero(first))))
    return [found[k] for k in np.cumsum(first) - 1]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        hubs = _hub_sets(batch.column("a"), batch.column("text_a"))
        for x, y in zip(hubs, _sets(batch.column("text_b")), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of ``links`` (a, b) can reach; written.

    Rounds of taking the neighbours' smallest label, then the label's own
    label, each written to the shared folder, until none changes.
    """
    edges = written(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .distinct(),
        "edges",
    )
    labels = written(
        edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("comp")),
        "labels",
    )
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"))
        lower = labels.join(near.agg(F.min("comp").alias("near")), "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        after = lower.join(jump, "low").select("node", F.least("low", "next").alias("comp"), "was")
        after, changed = counted(after, "labels", F.col("comp") != F.col("was"))
        dropped(labels)
        labels = after
        if not changed:
            dropped(edges)
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) once ``links`` (a, b) hold, too; nodes without a label are their own component.

    Only links between two components count, as links of the components; all the rest is done already.
    """
    ends = links.select("a", "b")
    for side in ("a", "b"):
        known = labels.select(F.col("node").alias(side), F.col("comp").alias(f"of_{side}"))
        ends = ends.join(known, side, "left")
    ends = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    new, n = counted(ends.where("a <> b").distinct(), "new_links")
    if not n:
        dropped(new)
        return labels
    tops = components(new)
    moved = labels.join(tops.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    moved = moved.select("node", F.coalesce("top", "comp").alias("comp"))
    fresh = tops.select("node", "comp").join(labels.select("node"), "node", "left_anti")
    after = written(moved.unionByName(fresh), "labels")
    dropped(labels, tops, new)
    return after


def _pair_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b): the members' texts move, the hubs' come to them; either join can be split if skewed."""
    full = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    full = full.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b")


def _likely_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and registers leave possible."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sides = pairs
    for side in ("b", "a"):
        sides = sides.join(
            sketches.select(
                F.col("cid").alias(side),
                F.col("n_shingles").alias(f"n_{side}"),
                F.col("registers").alias(f"registers_{side}"),
            ),
            side,
        )
    sides = sides.where(100 * small >= PERCENT * large).select("a", "b", "registers_a", "registers_b")
    return sides.mapInArrow(_likely, "a long, b long")


def _parts(left: DataFrame) -> DataFrame:
    """Members of open groups dealt to parts of about ``TOGETHER``: one part for each of those of the group's
    largest component, every part for each of the others (``beside``, ``TOGETHER`` at most)."""
    parts = F.ceil((F.col("k") - F.col("n_beside")) / TOGETHER).cast("int")
    own = F.pmod(F.xxhash64("cid", "band"), parts).cast("int")
    dealt = F.when(F.col("beside"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    return left.select("band", "cid", "comp", "top", "beside", F.explode(dealt).alias("part"))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components in each part of a group; rows come part by part.

    A member needs one link with another component: its likeliest partners
    are tried first, the others only as long as there is no link.
    """
    least = PERCENT / 100

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        names = ("cid", "comp", "n_shingles", "at_pivot", "beside")
        cid, comp, n, pivot, beside = (rows.column(c).to_numpy() for c in names)
        first = rows.column("part")[0].as_py() == 0  # those beside the largest component meet there only
        found = _matrix(rows.column("registers").combine_chunks())
        shared = rows.column("shared").combine_chunks()
        sets = np.split(shared.flatten().to_numpy(), np.cumsum(shared.value_lengths().to_numpy())[:-1])
        place, others, links = np.arange(len(cid)), np.array([len(x) for x in sets]) - pivot, []
        for i in np.flatnonzero(beside):
            at = np.flatnonzero((comp != comp[i]) & (~beside | (first & (place > i))))
            at = at[100 * np.minimum(n[at], n[i]) >= PERCENT * np.maximum(n[at], n[i])]
            most = np.minimum(pivot[at], pivot[i]) + np.minimum(others[at], others[i])
            at = at[(100 + PERCENT) * most >= PERCENT * (n[at] + n[i])]
            if not len(at):
                continue
            guess, used = estimate(found[i][None, :], found[at])
            likely = guess >= least - SIGMAS * np.sqrt(least * (1 - least) / np.maximum(used, 1))
            done = set()
            for j in at[likely][np.argsort(-guess[likely], kind="stable")]:
                if comp[j] not in done:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if (100 + PERCENT) * both >= PERCENT * (n[i] + n[j]):
                        done.add(comp[j])
                        links.append((cid[i], cid[j]))
        if not links:
            return None
        a, b = np.array(links, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        band, part = (table.column(c).to_numpy() for c in ("band", "part"))
        cuts = np.concatenate([[0], np.flatnonzero((band[1:] != band[:-1]) | (part[1:] != part[:-1])) + 1])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if (made := pairs(table.slice(i, j - i))) is not None:
                yield made
        rest = table.slice(cuts[-1]) if len(band) else None
    if rest is not None and (made := pairs(rest)) is not None:
        yield made


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of a group's smallest set a, its hub, and a member b: are they linked, and b's shingles outside a.

    Let b have no link with a, and one with c, whose set is no smaller than
    a's. Then b and c share more than b shares with a: at least ``need``
    shingles outside a. In one order for all, the first (outside - need + 1)
    shingles of either must then have one in common; ``slots`` is that number.
    """
    for batch in batches:
        linked, slots, outside = [], [], []
        hubs = _hub_sets(batch.column("a"), batch.column("text_a"))
        for hub, own in zip(hubs, _sets(batch.column("text_b")), strict=True):
            rest = np.setdiff1d(own, hub, assume_unique=True)
            both = len(own) - len(rest)
            linked.append(100 * both >= PERCENT * (len(hub) + len(rest)))
            least = -(-PERCENT * (len(own) + len(hub)) // (100 + PERCENT))
            slots.append(max(0, len(rest) - max(1, least - both) + 1))
            outside.append(rest.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("a"),
                batch.column("b"),
                pa.array(linked, pa.bool_()),
                pa.array(slots, pa.int32()),
                pa.array(outside, pa.list_(pa.int64())),
            ],
            names=["a", "b", "linked", "slots", "outside"],
        )


def _prefixes(beside: DataFrame) -> DataFrame:
    """(band, cid): the prefixes of members outside their hub, without what occurs once there.

    A band is a hub with a shingle.

    The rarest among the hub's members come first: those that occur once take
    up slots and pair with nothing; those that nearly all members have, which
    the hub happens to lack, come last.
    """
    some = beside.where("slots > 0").select("a", F.col("b").alias("cid"), "slots", "outside")
    rows = some.select("a", "cid", F.explode("outside").alias("shingle"))
    common = rows.groupBy("a", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(common, ["a", "shingle"]).groupBy("a", "cid")
    shared = shared.agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("shared"))  # inside one set
    left = F.col("slots") - (F.size("outside") - F.size("shared"))
    cut = some.join(shared, ["a", "cid"]).where(left > 0)
    cut = cut.select("a", "cid", F.explode(F.slice("shared", F.lit(1), F.greatest(left, F.lit(0)))["shingle"]).alias("shingle"))
    return cut.select(F.xxhash64("a", "shingle").alias("band"), "cid")


def _open_groups(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """The members (band, cid) of groups that hold several components; whether some are large.

    With comp, top (the group's largest component), k (members), beside (not of top) and n_beside (members that are not).
    A group with more than ``TOGETHER`` of those is large.
    """
    known = rows.join(labels.select(F.col("node").alias("cid"), "comp"), "cid", "left")
    known = known.select("band", "cid", F.coalesce("comp", "cid").alias("comp"))
    several = known.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band")
    several = several.agg(F.sum("n").alias("k"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"))
    several = several.where("comps > 1").select("band", "k", "top", (F.col("k") - F.col("top.n")).alias("n_beside"))
    left = known.join(several, "band").withColumn("beside", F.col("comp") != F.col("top.comp"))
    left = left.withColumn("top", F.col("top.comp"))
    return counted(left, "open_groups", F.col("n_beside") > TOGETHER)


def _hubs(members: DataFrame, order: list) -> DataFrame:
    """``members`` of different components than their group's first, a, by ``order``: (band, cid, comp, a, comp_a)."""
    hub = members.groupBy("band").agg(F.min(F.struct(*order, "cid", "comp")).alias("hub"))
    return members.join(hub.select("band", F.col("hub.cid").alias("a"), F.col("hub.comp").alias("comp_a")), "band")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cids = batch.column("cid").to_numpy()
        for i, _, hashes, rows in shingle_sets(batch.column("text")):
            columns = [pa.array(cids[i + rows]), pa.array(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "shingle"])


def _shared_shingles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(cid, shingle): those shingles of the members that another member has, too; written."""
    rows = texts.join(members.select("cid").distinct(), "cid", "left_semi").mapInArrow(_shingles, "cid long, shingle long")
    # by itself, so that a join with a frequent shingle can be split
    common = written(rows.groupBy("shingle").count().where("count > 1").select("shingle"), "common_shingles")
    shared = written(rows.join(common, "shingle"), "shared_shingles")
    dropped(common)
    return shared


def _able(shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """(cid, shared, n_shingles, registers) of the members that can have a link among themselves.

    A set's shingles that no other member has are outside every intersection,
    and a link needs PERCENT of either set's shingles inside.
    """
    sets = shared.groupBy("cid").agg(F.collect_list("shingle").alias("shared"))  # inside one set
    known = sets.join(sketches.select("cid", "n_shingles", "registers"), "cid")
    return known.where(100 * F.size("shared") >= PERCENT * F.col("n_shingles"))


def _at_pivots(left: DataFrame, shared: DataFrame) -> DataFrame:
    """(top, cid, at_pivot): how many shingles a member of a group shares with the pivot of its largest component.

    The pivot is the component's member in most groups. Two sets have no more
    in common than the less they share with the pivot and the less they share
    with others beside it.
    """
    often = left.where("not beside").groupBy("top", "cid").agg(F.count("*").alias("n")).groupBy("top")
    pivots = often.agg(F.max(F.struct("n", "cid"))["cid"].alias("cid"))
    own = pivots.join(shared, "cid").select("top", "shingle", F.lit(1).alias("there"))
    wanted = left.select("top", "cid").distinct().join(shared, "cid").join(own, ["top", "shingle"], "left")
    return wanted.groupBy("top", "cid").agg(F.count("there").alias("at_pivot"))


def _with_links(labels: DataFrame, likely: DataFrame, texts: DataFrame) -> DataFrame:
    """``labels`` once those of the ``likely`` pairs hold that the full sets confirm."""
    likely, n = counted(likely, "likely")
    if n:
        links = written(_pair_texts(likely, texts).mapInArrow(_linked, "a long, b long"), "links")
        labels = _merged(labels, links)
        dropped(links)
    dropped(likely)
    return labels


def _classes_linked(sketches: DataFrame, sketched: DataFrame) -> DataFrame | None:
    """(node, comp) of the classes that have a link, or None if none can have.

    Band groups are not expanded into pairs. First each member meets one hub
    of its group; links join classes into components. In groups that still hold
    several, those outside the largest component meet a member drawn from it.
    Members that share too few shingles with any other one are left out (see
    ``_able``). What is left then:

    - if ``TOGETHER`` members at most are outside the group's largest
      component, they are compared, by their registers and then in full, with
      each other and with all the rest, in parts of bounded size;
    - in any other group a missing link needs shingles in common outside the
      group's smallest set (see ``_outside``): only members that share one of
      those stay together, as groups of the next turn.

    Hubs grow in (size, id) from turn to turn, so that ends; nothing is
    capped. Copies with edits of their own, be there any number, share no such
    shingle. A turn works on the links between components only.
    """
    bands = sketches.select("cid", "n_shingles", "registers").mapInArrow(_bands, "band long, cid long")
    hubs = bands.groupBy("band").agg(F.min("cid").alias("a"), F.count("*").alias("k")).where("k > 1").select("band", "a")
    hubs = written(hubs, "hubs")  # by itself, so that the join with a large group can be split
    hits, n = counted(bands.join(hubs, "band"), "hits")
    dropped(hubs)
    if not n:
        return None
    texts = written(
        sketched.select(F.col("row").alias("cid"), "text").join(hits.select("cid").distinct(), "cid", "left_semi"),
        "candidate_texts",
    )
    pairs = hits.where("a <> cid").select("a", F.col("cid").alias("b")).distinct()
    likely = written(_likely_pairs(pairs, sketches), "likely")
    links = written(_pair_texts(likely, texts).mapInArrow(_linked, "a long, b long"), "links")
    labels = components(links)
    dropped(likely, links)
    groups = hits
    while True:
        left, _ = _open_groups(groups.select("band", "cid"), labels)
        drawn = left.where("not beside").groupBy("band").agg(F.min(F.struct(F.xxhash64("cid", "band"), "cid"))["cid"].alias("a"))
        drawn = left.where("beside").join(drawn, "band").select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b"))
        labels = _with_links(labels, _likely_pairs(drawn.distinct(), sketches), texts)
        shared = _shared_shingles(left, texts)
        able = written(_able(shared, sketches), "able")
        still, large = _open_groups(left.select("band", "cid").join(able.select("cid"), "cid", "left_semi"), labels)
        dropped(left, groups)
        left = still
        few = left.where(F.col("n_beside") <= TOGETHER)
        few = _parts(few).join(able, "cid").join(_at_pivots(few, shared), ["top", "cid"])
        few = few.repartition("band", "part").sortWithinPartitions("band", "part")
        links = written(few.mapInArrow(_within, "a long, b long"), "links")
        labels = _merged(labels, links)
        dropped(links)
        if not large:
            dropped(left, able, shared, texts)
            return labels
        sized = left.where(F.col("n_beside") > TOGETHER).join(able.select("cid", "n_shingles"), "cid")
        least = _hubs(sized, ["n_shingles"]).where("a <> cid").select("a", F.col("cid").alias("b")).distinct()
        beside = written(
            _pair_texts(least, texts).mapInArrow(
                _outside, "a long, b long, linked boolean, slots int, outside array<long>"
            ),
            "outside",
        )
        labels = _merged(labels, beside.where("linked").select("a", "b"))
        groups = written(_prefixes(beside), "prefixes")
        dropped(left, able, shared, beside)


def sketch_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None
) -> DataFrame:
    """One row per document: row (unique), doc_id, text, n_shingles, h1, h2 (the set's hash), registers; columns ``also``."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col, **{c: c for c in also or ()}).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty("text").alias("text"),
        *(also or ()),
    )
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL("n_shingles long, h1 long, h2 long, registers binary")])
    return written(rows.mapInArrow(_sketch, schema), "sketched")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents that links of similar five-word shingle sets join.

    Words are runs of non-space bytes after lower-casing A-Z. Documents with
    equal sets form one class, which is sketched once: per bucket of the hash
    the leading-zero count and ten mantissa bits of the smallest hash. Bands
    of registers give candidates, the collision-corrected estimate drops
    hopeless ones, and the rest is confirmed on the full sets.

    Nulls and empties: a text without words has no shingles and is linked with
    nothing; a text of fewer than five words has its whole sequence as its one
    shingle. A null id never names a component unless all its ids are null.
    Repeated rows share a component. An empty table gives no rows.

    Returns doc_id, n_shingles, component_id, kept (doc_id = component_id),
    and row_kept, which is true for one row of each component.
    """
    return _decided(sketch_documents(docs, id_col, text_col)).select(
        "doc_id", "n_shingles", "component_id", "kept", "row_kept"
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; see ``near_duplicates``.

    The other columns stay beside the sketches, as the texts do, and come back
    with the rows that stay.
    """
    inner = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)
    doc_id, text = (inner[docs.columns.index(c)] for c in (id_col, text_col))
    others = [F.col(c).alias(c) for c in inner if c != text]
    sketched = sketch_documents(
        rows.select(
            F.struct(F.col(text).isNull().alias("no_text"), *others).alias("others"),
            F.col(doc_id).alias("doc_id"),
            F.col(text).alias("text"),
        ),
        also=["others"],
    )
    dropped = _decided(sketched).where("not row_kept").select("row")
    kept = sketched.select("row", "text", "others").join(dropped, "row", "left_anti")
    whole = [F.when(~F.col("others.no_text"), F.col("text")) if c == text else F.col(f"others.{c}") for c in inner]
    return kept.select(*[w.alias(c) for w, c in zip(whole, inner, strict=True)]).toDF(*docs.columns)


def _decided(sketched: DataFrame) -> DataFrame:
    classes = written(
        sketched.where("n_shingles > 0")
        .groupBy("h1", "h2", "n_shingles")
        .agg(
            F.min("row").alias("cid"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"),
        ),
        "classes",
    )
    sketches = written(
        sketched.select(F.col("row").alias("cid"), "n_shingles", "registers").join(
            classes.select("cid"), "cid", "left_semi"
        ),
        "class_sketches",
    )
    labels = _classes_linked(sketches, sketched)
    if labels is not None:
        linked = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        heads = linked.where("comp is not null").groupBy("comp").agg(F.min("head").alias("top"))
        classes = written(
            linked.join(heads, "comp", "left").select(
                "h1", "h2", "n_shingles", F.coalesce("top", "head").alias("head")
            ),
            "classes_joined",
        )
    rows = sketched.select("row", "doc_id", "n_shingles", "h1", "h2")
    joined = rows.join(classes.select("h1", "h2", "n_shingles", "head"), ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return joined.select(
        "row",
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)).alias("row_kept"),
    )
