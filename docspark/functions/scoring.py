"""Importance of logged operations, as column expressions over an operation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: weights of (1, database priority, operation priority, semantic score, hotness, latency, write, broad)
WEIGHTS = [-0.2, 1.5, 0.9, 0.6, 0.4, 0.18, 0.2, -0.08]
# fixed values: keyword groups and their scores, the first that matches counts
SEMANTIC = [
    ("phone|telefone|otp|2fa|mfa|sms|verify|verification|verificar", 0.96),
    ("auth|session|sessao|login|token|oauth|password|senha|refresh", 0.78),
    ("payment|billing|invoice|order|checkout|pagamento|pedido", 0.72),
    ("user|profile|account|email|usuario|conta", 0.56),
    ("log|analytics|metric|report|audit|history|evento", 0.24),
]
OTHER_SEMANTIC = 0.45
# fixed values: keywords of an operation's kind; admin comes before write, as the first match counts
ADMIN, WRITE = "index|drop|make", "insert|put|update|delete|del|write|save|commit"
MAINTENANCE, QUERY = "flush|stats|backup|close|vacuum|checkpoint", "query|find|count|scan|where"


def kind_of(operation: Column) -> Column:
    name = F.lower(operation)
    return (
        F.when(name.rlike(ADMIN), "admin")
        .when(name.rlike(WRITE), "write")
        .when(name.rlike(MAINTENANCE), "maintenance")
        .when(name.rlike(QUERY), "query")
        .otherwise("read")
    )


def signature(database: Column, kind: Column, operation: Column, collection: Column, tests: Column, count: Column) -> Column:
    """``tests``: array of field-and-operator texts, in any order."""
    return F.concat_ws(
        "|",
        database,
        kind,
        F.lower(operation),
        F.coalesce(collection, F.lit("")),
        F.array_join(F.array_sort(tests), "&"),
        F.when(count, "count").otherwise("rows"),
    )


def semantic(*texts: Column) -> Column:
    """The score of the first group with a keyword in the texts; these are joined and lower-cased once."""

    def scored(text: Column) -> Column:
        out = F
        for words, score in SEMANTIC:
            found = F.lit(False)
            for word in words.split("|"):
                found |= F.contains(text, F.lit(word))
            out = out.when(found, score)
        return out.otherwise(OTHER_SEMANTIC)

    return F.element_at(F.transform(F.array(F.lower(F.concat_ws(" ", *texts))), scored), 1)


def hotness(hits: Column, scale: int = 64) -> Column:
    return F.least(F.lit(1.0), F.log1p(hits) / F.log(F.lit(float(scale))))


def importance(
    database_priority: Column, operation_priority: Column, semantic_score: Column, hits: Column,
    latency_ms: Column, kind: Column, broad: Column,
) -> Column:
    """Score from 0 to 10,000."""
    features = [
        F.lit(1.0),
        database_priority / 10,
        operation_priority / 10,
        semantic_score,
        hotness(hits),
        F.least(F.lit(1.0), latency_ms / 250),
        F.when(kind.isin("write", "admin"), 1.0).otherwise(0.0),
        F.when(broad, 1.0).otherwise(0.0),
    ]
    dot = F.lit(0.0)
    for weight, x in zip(WEIGHTS, features, strict=True):
        dot = dot + F.lit(weight) * x
    return F.round(10_000 / (1 + F.exp(-dot))).cast("long")


def confidence(hits: Column, database_priority: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.2) + hits / 12 + database_priority / 40)


def priority(value: Column) -> Column:
    """A priority from 0 to 10 to two decimals; anything else fails the job."""
    bad = F.raise_error(F.lit("a priority must be a number from 0 to 10")).cast("double")
    return F.when((value >= 0) & (value <= 10), F.round(value, 2)).otherwise(bad)


def database_rank(log: DataFrame, priorities: DataFrame) -> DataFrame:
    """(database, score, queries) from (database, signature) rows and (database, priority), best first."""
    per_signature = log.groupBy("database", "signature").agg(F.count("*").alias("hits"))
    sums = per_signature.groupBy("database").agg(
        F.sum("hits").alias("queries"), F.sum(hotness(F.col("hits"), 32)).alias("heat")
    )
    joined = priorities.join(sums, "database", "left")
    score = F.col("priority") * 100 + F.round(F.coalesce("heat", F.lit(0.0)) * 10)
    return joined.select(
        "database", score.cast("double").alias("score"), F.coalesce("queries", F.lit(0)).cast("long").alias("queries")
    ).orderBy(F.desc("score"), "database")


def ewma(rows: DataFrame, group: str, order: str, value: str, alpha: float = 0.25) -> DataFrame:
    """Exponentially weighted mean of ``value`` per group in ``order``: the first value starts it.

    One group's (order, value) pairs are held together, 16 bytes a row; split
    longer histories by time.
    """
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value].cast("double"))
    step = lambda old, x: F.when(old.isNull() | (old == 0), x).otherwise(old * (1 - alpha) + x * alpha)
    return rows.groupBy(group).agg(F.aggregate(pairs, F.lit(None).cast("double"), step).alias("ewma"))
