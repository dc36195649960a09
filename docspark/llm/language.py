"""Operator 4: language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import codes, grouped, ngrams, sums
from .common import dropped, pick, ship, text_or_empty, written
from .text_hash import mix

NGRAMS = (3, 4)
#: Documents of each language whose n-grams are counted, drawn by hash of the id; about so many of a larger number.
MAX_PER_LANGUAGE = 1000
#: N-grams that make up less of a language's sample are left out; so a language keeps 1 / LEAST_RATE at most,
#: whatever the sample's size and the number of languages.
LEAST_RATE = 2e-5
#: Bits of a filter for each n-gram of the language that has most.
BITS_PER_NGRAM = 32
#: A language contains an n-gram if its rate there is at least this share of the highest.
LEAST_SHARE = 0.1
HASHES = 3
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For runs [i, j) of texts: letters of each, and per n the hashes and where each text's begin.

    Texts are lower-cased; what is no letter counts as a space, and n-grams
    with two neighbouring spaces are left out.
    """
    for i, j in grouped(texts):
        found, begin = codes([t.lower() for t in texts[i:j]])
        letter = _letters()[found]
        plain = np.where(letter | (found == 0), found, np.uint32(32))
        gap = np.zeros(len(plain), bool)
        gap[:-1] = (plain[:-1] == 32) & (plain[1:] == 32)
        kinds = []
        for n in NGRAMS:
            hashes, inside = ngrams(plain, n)
            for k in range(n - 1):
                inside &= ~gap[k : k + len(inside)]
            at = np.flatnonzero(inside)
            kinds.append((mix(hashes[at]), np.searchsorted(at, begin)))
        yield i, j, sums(letter.astype(np.int64), begin, j - i), kinds


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            own = [texts[k] for k in np.flatnonzero(langs == lang)]
            for _, _, _, kinds in _grams(own):
                grams, counts = np.unique(np.concatenate([h for h, _ in kinds]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )


@dataclass
class Model:
    """Row p of ``table`` is a bitmask, in 64-bit words, of the languages whose filter has bit p set."""

    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray

    def positions(self, grams: np.ndarray, k: int) -> np.ndarray:
        step = (grams >> np.uint64(32)) | np.uint64(1)
        return ((grams + np.uint64(k) * step) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as 64-bit words."""
        out = self.table[self.positions(grams, 0)]
        for k in range(1, HASHES):
            out &= self.table[self.positions(grams, k)]
        return out


def build(languages: list[str], grams: np.ndarray, language: np.ndarray, rate: np.ndarray) -> Model:
    """Filters over (n-gram, language number, rate) triples."""
    words = max(1, -(-len(languages) // 64))
    largest = int(np.bincount(language).max()) if len(language) else 0
    size = 1 << max(12, (BITS_PER_NGRAM * largest).bit_length())
    model = Model(languages, np.zeros((size, words), np.uint64), np.zeros(len(languages)))
    if len(grams):
        order = np.argsort(grams, kind="stable")
        grams, language, rate = grams[order], language[order], rate[order]
        start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        most = np.repeat(np.maximum.reduceat(rate, start), np.diff(np.append(start, len(grams))))
        has = rate >= LEAST_SHARE * most
        bit = np.uint64(1) << (language[has] % 64).astype(np.uint64)
        for k in range(HASHES):
            np.bitwise_or.at(model.table, (model.positions(grams[has], k), language[has] // 64), bit)
        for i in range(len(languages)):
            fill = (model.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()
            model.false_positive[i] = fill**HASHES
    return model


def train(
    docs: DataFrame,
    max_per_language: int = MAX_PER_LANGUAGE,
    least_rate: float = LEAST_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learn the n-grams of each language from documents that are not held out."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).select(
        "doc_id", "lang", text_or_empty("text").alias("text"), F.xxhash64("doc_id").alias("draw")
    )
    usable = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = written(usable.groupBy("lang").agg(F.count("*").alias("size")), "language_sizes")  # a row per language
    place = F.col("draw") / F.lit(2.0**64) + 0.5  # evenly from 0 to 1
    drawn = usable.join(sizes, "lang").where(place * F.col("size") <= max_per_language).select("lang", "text")
    counts = drawn.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram")
    counts = written(counts.agg(F.sum("n").alias("n")).where("n > 1"), "language_ngrams")
    rates = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang")
    rates = rates.select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    found = rates.where(F.col("rate") >= least_rate).toArrow()
    dropped(sizes, counts)
    languages = sorted(set(found["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    return build(
        languages,
        found["gram"].to_numpy().view(np.uint64),
        np.array([number[x] for x in found["lang"].to_pylist()], np.int64),
        found["rate"].to_numpy(),
    )


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        n_languages = len(model.languages)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            best = np.full(batch.num_rows, n_languages)
            score = np.zeros(batch.num_rows)
            for i, j, letters, kinds in _grams(batch.column("text").to_pylist()):
                hits, n = np.zeros((n_languages, j - i)), np.zeros(j - i)
                for grams, at in kinds:
                    masks = model.masks(grams)
                    n += np.diff(at[: j - i + 1])
                    for x in range(n_languages):
                        bits = (masks[:, x // 64] >> np.uint64(x % 64)) & np.uint64(1)
                        hits[x] += sums(bits.astype(np.uint8), at, j - i)
                if n_languages:
                    wrong = model.false_positive[:, None]
                    hits = np.maximum(0, (hits - n * wrong) / (1 - np.minimum(wrong, 0.999)))
                    best[i:j] = np.where(letters > 0, hits.argmax(0), n_languages)
                    share = hits.max(0) / np.maximum(hits.sum(0), 1e-9)
                    score[i:j] = np.where(letters > 0, np.minimum(share, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language of each whole text.

    Each n-gram is looked up once: the AND of its rows is the bitmask of all
    languages that contain it. A language's count of such n-grams, less the
    false positives expected at its filter's fill, decides; the score is its
    share of all languages' counts. Ties go to the alphabetically first.

    Nulls and empties: a null text, or one without letters, is ``und`` with
    score 0; null ids are carried along, as not held out, and nothing is
    learned from them. An empty table gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
