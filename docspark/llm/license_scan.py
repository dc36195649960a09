"""Operator 6: license notices, by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick, text_or_empty, written

THRESHOLD = 0.75
#: Words are runs of letters, digits and non-ASCII of the lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand consecutively, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices whose words a line must contain, and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("no-warranty", "The software is provided as is, without warranty of any kind, express or implied"),
    ("reserved", "All rights reserved"),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def least_overlap(size: int, threshold: float) -> int:
    """Distinct words of a template of ``size`` words that a block must hold."""
    return next(k for k in range(size + 1) if k >= threshold * size)


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        found = F.element_at(words, i + 1) == parts[0]
        for k, part in enumerate(parts[1:], 2):
            found &= F.element_at(words, i + k) == part
        return found

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(
        F.array().cast("array<int>")
    )


def _best_labels(matches: str) -> Column:
    """Labels of a block's matches, without those that a better match explains.

    A match goes if one of higher containment, or of as much with more words,
    shares all of its words: "CC BY-NC 4.0" is not also "CC BY 4.0". Two
    notices in one block both stay, and so do equally good ones.
    """

    def explained(m: Column) -> Column:
        return F.exists(
            matches,
            lambda o: (
                (o["containment"] > m["containment"])
                | ((o["containment"] == m["containment"]) & (F.size(o["shared"]) > F.size(m["shared"])))
            )
            & (F.size(F.array_except(m["shared"], o["shared"])) == 0),
        )

    return F.transform(F.filter(matches, lambda m: ~explained(m)), lambda m: m["label"])


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base phrases and the templates that a document's text blocks contain.

    A block is a line. A template is found if the block holds at least
    ``threshold`` of its distinct words. All words get one order, the rarest
    first by the blocks that hold them. A block that reaches the threshold
    must hold one of a template's first (size - needed + 1) words: that prefix
    makes the candidates; the block's size and the words after the shared one
    bound the overlap before it is counted. Only the templates' own words take
    part, so what is collected or broadcast is bounded by the templates.

    All matches are in ``found``; a block's labels are those of its best ones
    (``_best_labels``).

    Nulls and empties: a null text counts as empty and has no words; null ids
    are carried along; repeated rows are scanned one by one. An empty table
    gives no rows. Other columns are ignored.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 with a base phrase, else the best containment), and
    found (array of block, label, containment).
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(words_of(text)))) for label, text in templates]
    needed = [least_overlap(len(words), threshold) for _, words in sets]
    vocabulary = sorted({w for _, words in sets for w in words})
    text = ascii_lower(text_or_empty("text"))
    lines = F.transform(F.split("low", "\n"), lambda line: F.array_remove(F.split(line, SEPARATORS), ""))
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("low")
    )
    rows = rows.withColumn("lines", lines).withColumn("words", F.flatten("lines"))
    nothing = F.array().cast("array<int>")
    starts = {}
    for phrase in BASE_PHRASES:
        may = F.lit(True)
        for part in phrase.split(" "):
            may &= F.contains(F.col("low"), F.lit(part))
        starts[phrase] = F.when(may, _starts(F.col("words"), phrase)).otherwise(nothing)
    known = F.array(*[F.lit(w) for w in vocabulary])
    blocks = F.filter(
        F.transform("lines", lambda line, i: F.struct(i.alias("block"), F.array_intersect(line, known).alias("words"))),
        lambda b: F.size(b["words"]) >= min(needed),
    )
    scanned = written(
        rows.select(
            "row",
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            *[s.alias(f"at_{i}") for i, s in enumerate(starts.values())],
            blocks.alias("blocks"),
        ),
        "license_rows",
    )
    block_words = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.words")
    counts = {r["word"]: r["count"] for r in block_words.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ranked = [sorted(order[w] for w in words) for _, words in sets]
    prefix = spark.createDataFrame(
        [
            (rank, k, i, len(r), needed[k])
            for k, r in enumerate(ranked)
            for i, rank in enumerate(r[: len(r) - needed[k] + 1])
        ],
        "rank int, template int, i int, size int, needed int",
    )
    table = spark.createDataFrame(
        [(k, label, r) for k, ((label, _), r) in enumerate(zip(sets, ranked, strict=True))],
        "template int, label string, ranks array<int>",
    )
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
    in_order = block_words.select(
        "row", "block", F.array_sort(F.transform("words", lambda w: ranks[w])).alias("own")
    )
    pairs = (
        in_order.select("row", "block", "own", F.posexplode("own").alias("j", "rank"))
        .join(F.broadcast(prefix), "rank")
        .where(F.size("own") >= F.col("needed"))
        .where(F.col("i") + F.least(F.col("size") - F.col("i"), F.size("own") - F.col("j")) >= F.col("needed"))
        .select("row", "block", "own", "template", "needed")
        .dropDuplicates(["row", "block", "template"])
        .join(F.broadcast(table), "template")
        .withColumn("shared", F.array_intersect("own", "ranks"))
        .where(F.size("shared") >= F.col("needed"))
        .withColumn("containment", F.size("shared") / F.size("ranks"))
    )
    of_block = pairs.groupBy("row", "block").agg(F.collect_list(F.struct("label", "containment", "shared")).alias("all"))
    matches = of_block.groupBy("row").agg(
        F.max(F.array_max(F.transform("all", lambda m: m["containment"]))).alias("best"),
        F.array_distinct(F.flatten(F.collect_list(_best_labels("all")))).alias("of_templates"),
        F.array_sort(
            F.flatten(
                F.collect_list(
                    F.transform(
                        "all", lambda m: F.struct("block", m["label"].alias("label"), m["containment"].alias("containment"))
                    )
                )
            )
        ).alias("found"),
    )
    at = F.concat(*[F.col(f"at_{i}") for i in range(len(BASE_PHRASES))])
    base = F.concat(
        *[
            F.when(F.size(f"at_{i}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
            for i, label in enumerate(BASE_PHRASES.values())
        ]
    )
    joined = scanned.select("row", "doc_id", "n_words", at.alias("at"), base.alias("base")).join(matches, "row", "left")
    labels = F.array_union("base", F.coalesce("of_templates", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "found",
    )


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The digest columns by comparing every line with every template; labels as ``_best_labels`` has them."""
    values = ", ".join(
        "('{}', [{}], {})".format(
            label, ", ".join(f"'{w}'" for w in sorted(set(words_of(text)))), least_overlap(len(set(words_of(text))), threshold)
        )
        for label, text in templates
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    phrases = " UNION ALL ".join(
        "SELECT doc_id, '{}' AS label, i - 1 AS place FROM numbered WHERE {}".format(
            label, " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(phrase.split(" ")))
        )
        for phrase, label in BASE_PHRASES.items()
    )
    return f"""
        WITH low AS (
            SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents
        ), words AS (
            SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM low
        ), numbered AS (
            SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
        ), phrases AS ({phrases}),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                   list(DISTINCT label) AS labels
            FROM phrases GROUP BY doc_id
        ), lines AS (
            SELECT row_number() OVER () AS line_id, doc_id, line
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM low)
        ), templates(label, words, needed) AS (VALUES {values}),
        matches AS (
            SELECT doc_id, line_id, label, shared, len(shared) AS n, len(shared) / len(words) AS c
            FROM (SELECT doc_id, line_id, label, words, needed,
                         list_intersect(list_distinct(regexp_extract_all(line, '{WORD}')), words) AS shared
                  FROM lines, templates)
            WHERE len(shared) >= needed
        ), found AS (
            SELECT doc_id, list(DISTINCT label) FILTER (WHERE NOT explained) AS labels, max(c) AS best
            FROM (SELECT *, EXISTS (SELECT 1 FROM matches o WHERE o.line_id = m.line_id AND list_has_all(o.shared, m.shared)
                                    AND (o.c > m.c OR (o.c = m.c AND o.n > m.n))) AS explained FROM matches m)
            GROUP BY doc_id
        )
        SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
               first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(
                   coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
        FROM words LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
    """
