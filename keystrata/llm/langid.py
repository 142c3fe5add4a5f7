"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of other characters than letters becomes one
space. N-grams of 1 to 3 characters are hashed into buckets; the log-probability
matrix (buckets x languages, float32) is broadcast and texts are scored in
batches of code points, a sparse matrix product by gather and segmented sum.
A long text is folded and scored in pieces that carry their last two code points
over, so its n-grams are those of the whole text whatever the size of a piece.

Training counts come from a sample of about TRAIN_DOCS documents a language,
chosen by a hash of the row, whose partial counts are summed by Spark. All
languages are learned: the matrix has at most MATRIX_CELLS numbers, so more
languages have fewer buckets, and more than fit at MIN_BUCKETS are an error.
Scoring reads whole texts.

Edge cases: null text, or text without a letter, gives `und` and score 0; with
nothing to learn from, every text is `und`; repeated rows train as often as they
occur; ties go to the language that sorts first; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, fresh, releasing, small_batches, table

#: Buckets of n-grams: as many as let the matrix of all languages have at most MATRIX_CELLS numbers (64 MB).
MAX_BUCKETS, MIN_BUCKETS, MATRIX_CELLS = 1 << 15, 1 << 10, 1 << 24
TRAIN_DOCS = 1500
#: Code points that are scored at once.
CHUNK = 1 << 19
#: N-grams after which more text adds no more certainty: keeps scores of mixed texts away from 1.
CERTAIN_AFTER = 120
SMOOTHING = 0.5

_SPACE = np.uint32(32)


def _letters() -> np.ndarray:
    """For each code point of the basic plane and beyond, whether it is a letter."""
    table_ = np.zeros(0x110000, bool)
    table_[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return table_


_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    return _LETTER


def code_points(text: str, size: int = CHUNK) -> Iterator[np.ndarray]:
    """Lower-case letters of a text with one space for each run between them, and one at either end, in pieces.

    Every piece has the two code points before it in front (zeros at the beginning). Nothing for a text without letters.
    """
    before = np.array([0, 0, _SPACE], np.uint32)
    for k in range(0, len(text), size):
        # Capital sigma is the one letter whose lower case depends on its neighbours.
        low = text[k : k + size].replace("Σ", "σ").lower()
        raw = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = letter_table()[raw]
        keep = ok.copy()
        keep[1:] |= ok[:-1]  # the first of each run of others
        keep[0] |= before[-1] != _SPACE
        piece = np.concatenate([before, np.where(ok, raw, _SPACE)[keep].astype(np.uint32)])
        if k + size >= len(text) and piece[-1] != _SPACE:
            piece = np.append(piece, _SPACE)
        if len(piece) > len(before):
            yield piece
            before = piece[-2:]


def hashed(cps: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams that end at each code point but the first two, which only stand before: shape (places, 3)."""
    a = cps.astype(np.uint32)
    one = a[2:] * np.uint32(0x9E3779B1)
    two = (one ^ (a[1:-1] * np.uint32(0x85EBCA77) + np.uint32(1))) * np.uint32(0xC2B2AE3D)
    three = (two ^ (a[:-2] * np.uint32(0x27D4EB2F) + np.uint32(2))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    return np.stack([x >> shift for x in (one, two, three)], 1)


def log_likelihoods(texts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) sums of log probabilities, and the number of n-grams; 0 of these: no letter."""
    sums, counts = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    # The gathered weights of a batch stay at a few dozen MB however many languages there are.
    most = max(1 << 10, min(CHUNK, (1 << 23) // max(1, weights.shape[1])))

    def flush():
        nonlocal held, size
        if not held:
            return
        starts = np.cumsum([0] + [len(x) for _, x in held[:-1]])
        grams = hashed(np.concatenate([x for _, x in held]), len(weights))
        per_place = np.zeros((len(grams) + 2, weights.shape[1]), np.float32)
        per_place[2:] = weights[grams[:, 0]] + weights[grams[:, 1]] + weights[grams[:, 2]]
        per_place[starts] = 0  # what only stands before a piece
        per_place[starts + 1] = 0
        parts = np.add.reduceat(per_place, starts, axis=0, dtype=np.float64)
        for (i, x), p in zip(held, parts, strict=True):
            sums[i] += p
            counts[i] += 3 * (len(x) - 2)
        held, size = [], 0

    for i, t in enumerate(texts):
        for piece in code_points(t, min(CHUNK, most)) if t else ():
            held.append((i, piece))
            size += len(piece)
            if size >= most:
                flush()
    flush()
    return sums, counts


class Model:
    """Language names in order and the matrix of log probabilities (buckets x languages)."""

    def __init__(self, languages: list[str], weights: np.ndarray, priors: np.ndarray):
        self.languages, self.weights, self.priors = languages, weights.astype(np.float32), priors

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums, counts = log_likelihoods(texts, self.weights)
        scale = np.minimum(1.0, CERTAIN_AFTER / np.maximum(counts, 1))[:, None]
        logits = sums * scale + self.priors * scale
        best = logits.argmax(1)
        e = np.exp(logits - logits.max(1, keepdims=True))
        score = (e.max(1) / e.sum(1)).clip(0, 1)
        none = counts == 0
        return ["und" if n else self.languages[b] for n, b in zip(none, best, strict=True)], np.where(none, 0.0, score)


def _count(buckets: int):
    out = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def rows(totals):
        for lang, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some])], schema=out)

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang, text in zip(langs, texts, strict=True):
                for cps in code_points(text):
                    n = totals.setdefault(lang, np.zeros(buckets, np.int64))
                    n += np.bincount(hashed(cps, buckets).ravel(), minlength=buckets)
                if len(totals) * buckets > MATRIX_CELLS // 8:
                    yield from rows(totals)
                    totals = {}
        yield from rows(totals)

    return run


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model of rows (doc_id, text, lang); rows without text or lang teach nothing."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    most = MATRIX_CELLS // MIN_BUCKETS
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).toPandas()
    if len(sizes) > most:
        raise ValueError(f"over {most} languages: the matrix would be too large to broadcast")
    if not len(sizes):
        return Model([], np.zeros((MIN_BUCKETS, 0)), np.zeros(0))
    buckets = min(MAX_BUCKETS, 1 << (MATRIX_CELLS // len(sizes)).bit_length() - 1)
    sizes["share"] = np.minimum(1.0, train_docs / sizes["n"])
    shares = labelled.sparkSession.createDataFrame(sizes[["lang", "share"]])  # a row for each language, of a checked number
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")
    small_batches(labelled.sparkSession)
    counts = sample.mapInArrow(releasing(_count(buckets)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    matrix = np.zeros((buckets, len(languages)))
    column = {lang: k for k, lang in enumerate(languages)}
    matrix[counts["bucket"].to_numpy(int), counts["lang"].map(column).to_numpy(int)] = counts["n"].to_numpy()
    p = (matrix + SMOOTHING) / (matrix + SMOOTHING).sum(0, keepdims=True)
    number = dict(zip(sizes["lang"], sizes["n"], strict=True))
    total = sum(number[x] for x in languages)
    return Model(languages, np.log(p), np.log([number[x] / total for x in languages]))


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang, score) of a text column."""
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.priors))

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)

        def frames(batches):
            for texts in batches:
                lang, score = m.predict(texts.tolist())
                yield pd.DataFrame({"lang": lang, "score": score})

        yield from releasing(frames)(batches)

    small_batches(spark)
    return run(text)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), predicted(spark, model, F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


#: A document of a language that the model is this unsure of is rejected.
REJECT_BELOW = 0.4


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognised language go (no letters, or a score under REJECT_BELOW)."""
    model = fit(docs)
    p = fresh(docs, "predicted")
    scored = docs.withColumn(p, predicted(spark, model, F.col("text")))
    return scored.where((F.col(p)["lang"] != "und") & (F.col(p)["score"] >= REJECT_BELOW)).drop(p)
