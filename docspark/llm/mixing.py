"""Operator 10: temperature mixing of sources, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, text_or_empty, written

MAX_REPETITION = 2.0
BLOCK_TOKENS = 1 << 18
#: Rows in a part of a source's permutation that is summed up by one task.
PART_ROWS = 4096
#: Exponents tried in one job; a round narrows the interval by one more than that.
_GRID = 15
_ROUNDS = 6
_SPACE = r"[\x20\x09-\x0D]+"


@dataclass
class Mix:
    """The exponent, and per source: weight, budget (tokens to emit), tokens there are."""

    exponent: float
    weights: DataFrame


def _statistics(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, largest repetition) of the weights at each exponent, in one job."""
    z = [F.sum(F.pow("share", F.lit(a))) for a in exponents]
    s = [F.sum(F.pow("share", F.lit(a)) * F.log("share")) for a in exponents]
    row = shares.agg(*z, *s, F.min("share"), F.max("share")).first()
    n, low, high = len(exponents), row[-2], row[-1]
    return [
        (math.log(row[i]) - a * row[n + i] / row[i], (high / low) ** (1 - a)) for i, a in enumerate(exponents)
    ]


def temperature_mix(
    sizes: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None
) -> Mix:
    """Weights share**exponent, normalised, for sources of (source, tokens, rows).

    The exponent is bisected in [0, 1]: the smallest at which no source is
    repeated more than ``max_repetition`` times, or the one whose weights have
    ``target_entropy`` (nats). Many exponents are tried in one aggregation, so
    the sources are never collected, however many there are.

    The budget is the least at which every source is used at least once, so
    no document is dropped: the source with the least repetition has one.
    """
    some = sizes.where("tokens > 0")
    total = some.agg(F.sum("tokens")).first()[0]
    if not total:
        weights = sizes.select("*", F.lit(0.0).alias("weight"), F.col("tokens").cast("double").alias("budget"))
        return Mix(1.0, weights)
    shares = some.withColumn("share", F.col("tokens") / F.lit(total))
    low, high = 0.0, 1.0

    def fits(entropy: float, repetition: float) -> bool:
        return entropy <= target_entropy if target_entropy is not None else repetition <= max_repetition

    if fits(*_statistics(shares, [0.0])[0]):
        high = 0.0
    for _ in range(_ROUNDS if high else 0):
        grid = [low + (high - low) * (i + 1) / (_GRID + 1) for i in range(_GRID)]
        good = [a for a, x in zip(grid, _statistics(shares, grid), strict=True) if fits(*x)]
        bad = [a for a in grid if a not in good]
        low, high = max([low, *bad]), min([high, *good])
    powers = shares.withColumn("power", F.pow("share", F.lit(high)))
    z, scale = powers.agg(F.sum("power"), F.max(F.col("tokens") / F.col("power"))).first()
    found = powers.select("source", (F.col("power") / z).alias("weight"), (F.col("power") * scale).alias("budget"))
    joined = sizes.join(found, sizes.source.eqNullSafe(found.source), "left").select(
        sizes["*"], F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("budget", F.lit(0.0)).alias("budget")
    )
    return Mix(high, written(joined, "mix_weights"))


def mix_sources(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed stream: one row for each emitted copy of a document.

    Tokens are words between ASCII white space. Each source's documents are
    permuted anew in every epoch; its stream is epoch after epoch, until its
    budget is met (the last document is emitted if its middle is inside).
    Blocks take each source's stream in the proportion of the weights, about
    ``block_tokens`` in all, and are permuted inside.

    A source is split into parts by the permutation's own hash. Totals of the
    parts give prefix sums, so that a source may hold any share of the rows.

    Nulls and empties: null is a source of its own; documents without tokens
    are emitted once; ids may be null or repeat, each row is emitted by
    itself. An empty table gives no rows. Other columns are ignored.

    Returns doc_id, text_hash, source, epoch, tokens, weight, block, slot.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).withColumn("text", text_or_empty("text"))
    rows = written(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "source",
            F.xxhash64("text").alias("text_hash"),
            F.size(F.array_remove(F.split("text", _SPACE), "")).cast("long").alias("tokens"),
        ),
        "mix_rows",
    )
    sizes = written(
        rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "mix_sizes"
    )
    plan = temperature_mix(sizes, max_repetition, target_entropy).weights.select(
        F.col("source").alias("name"),
        F.col("tokens").alias("of_source"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / PART_ROWS)).alias("parts"),
        "weight",
        "budget",
    )
    epochs = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.greatest("of_source", F.lit(1)) - F.lit(1e-9)))
    copies = rows.join(plan, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs.cast("int") - 1)))
    draw = F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash", "row")
    copies = copies.withColumn("draw", draw).withColumn(
        "part", F.floor(F.pmod("draw", F.lit(1 << 30)) / (1 << 30) * F.col("parts"))
    )
    copies = written(copies, "mix_copies")
    group = ["source", "epoch"]
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = copies.groupBy(*group, "part").agg(F.sum("tokens").alias("sum"))
    totals = totals.select(
        *[F.col(c).alias(f"t_{c}") for c in (*group, "part")], F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before")
    )
    match = F.col("source").eqNullSafe(F.col("t_source"))
    for c in ("epoch", "part"):
        match &= F.col(c) == F.col(f"t_{c}")
    inside = Window.partitionBy(*group, "part").orderBy(F.pmod("draw", F.lit(1 << 30)), "row")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(totals, match)
    at = F.col("epoch") * F.col("of_source") + F.col("before") + F.col("inside")
    placed = placed.withColumn("at", at).where(
        (F.col("epoch") == 0) | ((F.col("tokens") > 0) & (F.col("at") + F.col("tokens") / 2 < F.col("budget")))
    )
    quota = F.greatest(F.col("weight") * block_tokens, F.lit(1e-9))
    placed = placed.withColumn("block", F.when(F.col("weight") > 0, F.floor(F.col("at") / quota)).otherwise(0).cast("long"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy("draw", "row"))
    return placed.select(
        "doc_id", "text_hash", "source", "epoch", "tokens", "weight", "block", (slot - 1).cast("int").alias("slot")
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, each as often as the mix emits it, with their own columns."""
    stream = mix_sources(docs, text_col=text_col, id_col=id_col, **options)
    copies = stream.groupBy("doc_id", "text_hash", "source").agg(F.count("*").alias("n"))
    names = docs.columns
    i, t, s = (f"_{names.index(c)}" for c in (id_col, text_col, options.get("source_col", "source")))
    rows = docs.toDF(*[f"_{k}" for k in range(len(names))])
    rows = rows.withColumn("_hash", F.xxhash64(text_or_empty(t)))
    # equal rows are told apart by their number, and share their copies
    same = rows.groupBy(i, "_hash", s).agg(F.count("*").alias("_same"))
    keys = written(
        same.join(
            copies,
            same[i].eqNullSafe(copies.doc_id) & (F.col("_hash") == F.col("text_hash")) & same[s].eqNullSafe(copies.source),
        ).select(F.col(i).alias("k"), F.col("_hash").alias("h"), F.col(s).alias("z"), F.ceil(F.col("n") / F.col("_same")).alias("n")),
        "mix_keys",
    )
    match = F.col(i).eqNullSafe(F.col("k")) & (F.col("_hash") == F.col("h")) & F.col(s).eqNullSafe(F.col("z"))
    out = rows.join(keys, match).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select(*[f"_{k}" for k in range(len(names))]).toDF(*names)
