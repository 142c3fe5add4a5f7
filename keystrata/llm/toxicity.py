"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs of other scripts and digit or symbol
substitutions inside words to Latin letters, and turns all else into one space;
words with accents are looked up with them and, for stems in plain letters, also
without. The lexicon holds word beginnings (a space and at
least MIN_STEM letters) that are learned from labelled texts: those far more
frequent in toxic documents, weighted by log odds, of stems that begin alike the
one with the most evidence. A match inside an exception
phrase, learned (a stem's word and its neighbour, found in clean documents) or
given, counts nothing. The hits' weights are summed, set against the length, and
a logistic curve fitted to the labels turns both into a score.

Learning uses a sample of about TRAIN_DOCS labelled documents chosen by a hash
of doc_id, a documented bound, which bounds the lexicon too: every stem in it is
held by MIN_DOCS toxic documents of the sample. Document frequencies of stems are
summed by Spark. Every document is scored over its whole text, in pieces that are
cut at white space only and overlap by the words of the longest phrase, so a score
doesn't depend on where the cuts are.

Edge cases: null and empty texts score as no hit; conflicting labels of a
document each count; repeated rows are scored alike and teach as often as they
occur; with no label of one kind, or no documents, the lexicon is empty and every
score is the base rate below 0.5; an empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, table

TRAIN_DOCS = 20_000
MIN_STEM, MAX_STEM = 3, 12
#: A stem is learned if it is this many times as frequent in toxic documents, in at least so many of them, and
#: its evidence (documents times log ratio) exceeds what chance gives the best of all stems by this much.
MIN_RATIO, MIN_DOCS, MARGIN = 20.0, 3, 3.0
#: Characters after which a text is cut at the next white space.
CHUNK = 1 << 18

#: Letters of other scripts that look like Latin ones, and what is written for a letter.
HOMOGLYPHS = dict(
    zip(
        "абвгеёзікмнорстухуіјѕԁԛԝһӏαβγδεικνορτυχωøłđıßæœ",
        "a b b r e e 3 i k m h o p c t y x y i j s d q w h l a b y d e i k v o p t u x w o l d i ss ae oe".split(),
        strict=True,
    )
)
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser board", "scum line", "pond scum")

_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"(?<=[a-z])[0-9@$!|€]+(?=[a-z])|(?<![a-z0-9@$!|€])[0-9@$€]+(?=[a-z])|(?<=[a-z])[0-9@$€]+(?![a-z0-9@$!|€])")
_ACCENTED = re.compile(r"(?<= )(?=[^ ]*[^\x00-\x7f])[^ ]+")
_FOLD = str.maketrans(HOMOGLYPHS)
_SUBS = str.maketrans(SUBSTITUTES)
_ZERO = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_ANY = re.compile(r"[0-9@$!|\u20ac]")
_BLANK = re.compile(r"[ \t\r\n]")


def fold_text(text: str) -> str:
    """Folded words, one space before each and one after the last; accents stay."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", _ZERO.sub("", low)).translate(_FOLD)
    if _ANY.search(low):
        low = _MIXED.sub(lambda m: m[0].translate(_SUBS), low)
    return " " + " ".join(_WORD.findall(low)) + " "


def unaccented(folded: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c))


def _pieces(text: str) -> Iterator[str]:
    """Folded pieces of a text, cut at white space: folding changes nothing across it."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + CHUNK)
        end = found.start() if found else len(text)
        yield fold_text(text[at:end])
        at = end


def _windows(text: str, words: int) -> Iterator[tuple[str, int, int]]:
    """(folded words, from, to): every word of a text begins from <= place < to in one window, with `words` words known around it."""
    kept, begin = " ", 0
    waiting = None
    for piece in _pieces(text):
        if waiting is not None:
            piece = waiting[:-1] + piece if len(piece) > 2 else waiting
        else:
            piece, begin = (piece if len(piece) > 2 else kept), 0
        stop = len(piece) - 1
        for _ in range(words):
            stop = max(0, piece.rfind(" ", 0, stop))
        stop = max(stop, begin)
        yield piece, begin, stop
        back = stop
        for _ in range(words):
            back = max(0, piece.rfind(" ", 0, back))
        waiting, begin = piece[back:], stop - back
    if waiting is not None:
        yield waiting, begin, len(waiting) - 1


class Lexicon:
    """Stems and exceptions in one automaton, and the curve from hits to score."""

    def __init__(self, stems: dict[str, float], exceptions: list[str], curve: tuple[float, float, float]):
        self.stems, self.exceptions, self.curve = stems, exceptions, curve
        self.automaton = ahocorasick.Automaton()
        for s, w in stems.items():
            self.automaton.add_word(" " + s, (len(s) + 1, w))
        for p in exceptions:
            self.automaton.add_word(f" {p} ", (len(p) + 2, tuple(k for k, c in enumerate(f" {p}") if c == " ")))
        if stems or exceptions:
            self.automaton.make_automaton()
        self.around = max((p.count(" ") + 1 for p in exceptions), default=1)

        # Stems in plain letters, also looked for in accented words once their accents are gone.
        plain = {s_: w for s_, w in stems.items() if s_.isascii() and len(s_) >= 5}
        self.disguised = None
        if plain:
            self.disguised = ahocorasick.Automaton()
            for s_, w in plain.items():
                self.disguised.add_word(" " + s_, w)
            self.disguised.make_automaton()
        self._plain: dict[str, float] = {}

    def _disguise(self, word: str) -> float:
        """Weight that an accented word has without its accents, or 0."""
        got = self._plain.get(word)
        if got is None:
            if len(self._plain) > 200_000:
                self._plain.clear()
            plain = unaccented(word)
            got = self._plain[word] = max((w for _, w in self.disguised.iter(f" {plain} ")), default=0.0) if plain != word else 0.0
        return got

    def _found(self, piece: str) -> dict[int, float]:
        """Weight of each hit by its place, without those inside exception phrases."""
        found: dict[int, float] = {}
        harmless: set[int] = set()
        for end, (length, w) in self.automaton.iter(piece):
            start = end - length + 1
            if isinstance(w, tuple):
                harmless.update([start + k for k in w])
            else:
                found[start] = max(w, found.get(start, 0.0))
        if self.disguised is not None and not piece.isascii():
            # Accents may be put on a listed word: what only shows without them counts too.
            for m in _ACCENTED.finditer(piece):
                if w := self._disguise(m[0]):
                    found.setdefault(m.start() - 1, w)
        return {at: w for at, w in found.items() if at not in harmless} if harmless else found

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, hits and words of a text."""
        total, hits, words = 0.0, 0, 0
        for piece, begin, stop in _windows(text or "", self.around):
            words += piece.count(" ", begin, stop)
            if self.stems:
                found = [w for at, w in self._found(piece).items() if begin <= at < stop]
                total += sum(found)
                hits += len(found)
        return total, hits, words

    def features(self, text: str | None) -> tuple[float, float]:
        total, _, words = self.weigh(text)
        return float(np.log1p(total)), total / np.sqrt(words + 25.0)

    def score(self, texts) -> np.ndarray:
        bias, a, b = self.curve
        x = np.array([self.features(t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(bias + x @ np.array([a, b]), -40, 40)))


def _stems(batches):
    """Document frequencies of stems and of word pairs, by label."""
    out = pa.schema([("toxic", pa.int32()), ("stem", pa.string()), ("n", pa.int64())])
    seen = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = {w for piece in _pieces(text) for w in piece.split()}
            seen[toxic].update({w[:k] for w in words for k in range(MIN_STEM, min(len(w), MAX_STEM) + 1)})
            seen[toxic][""] += 1
    for toxic, c in seen.items():
        if c:
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(c), pa.int32()), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], schema=out)


def _learned_exceptions(stems: dict[str, float]):
    """Neighbours of a stem's word, by label."""
    out = pa.schema([("toxic", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches):
        auto = ahocorasick.Automaton()
        for s in stems:
            auto.add_word(" " + s, len(s) + 1)
        auto.make_automaton()
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                phrases = set()
                for piece, begin, to in _windows(text, 1):
                    for end, n in auto.iter(piece):
                        start = end - n + 1
                        if not begin <= start < to:
                            continue
                        stop = piece.index(" ", start + 1)
                        before, after = piece[piece.rfind(" ", 0, start) + 1 : stop], piece[start + 1 : piece.find(" ", stop + 1)]
                        phrases |= {p for p in (before, after) if p.count(" ") == 1 and p[0] != " "}
                seen[toxic].update(phrases)
        for toxic, c in seen.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(c), pa.int32()), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], schema=out)

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Bias and non-negative slopes by ridge logistic regression, Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (p - y) + ridge @ w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-6 * np.eye(3), grad)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0)), float(max(w[2], 0.0))


def _by_label(rows: DataFrame, key: str) -> DataFrame:
    """Documents of either label that hold each key."""
    of = lambda label: F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("n"))), F.lit(0))
    return rows.groupBy(key).agg(of(1).alias("bad"), of(0).alias("good"))


def _best_of_each_beginning(group: pd.DataFrame) -> pd.DataFrame:
    """Of stems that begin alike, the one with the most evidence, then the longest."""
    group = group.assign(length=group["stem"].str.len()).sort_values(["evidence", "length", "stem"], ascending=[False, False, True])
    chosen: set[str] = set()
    begun: set[str] = set()
    for stem in group["stem"]:
        if stem not in begun and not any(stem[:k] in chosen for k in range(MIN_STEM, len(stem))):
            chosen.add(stem)
            begun |= {stem[:k] for k in range(MIN_STEM, len(stem) + 1)}
    return group[group["stem"].isin(chosen)][["stem", "ratio"]]


def labelled_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, toxic) of about train_docs labels, chosen by a hash of doc_id; only chosen texts move."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(draw < train_docs / max(n, train_docs))
    # Labels of one document are drawn together, so the size is checked before the broadcast.
    side = F.broadcast(chosen) if chosen.count() <= 4 * train_docs else chosen
    return docs.select("doc_id", "text").join(side, "doc_id")


def fit(labelled: DataFrame) -> Lexicon:
    """A lexicon of rows (doc_id, text, toxic)."""
    sample = labelled.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1)).select("text", F.col("toxic").cast("int").alias("toxic")).persist()
    small_batches(labelled.sparkSession)
    counted = _by_label(sample.mapInArrow(_stems, "toxic int, stem string, n long"), "stem").persist()
    totals = counted.where("stem = ''").collect()
    n_bad, n_good = (totals[0]["bad"], totals[0]["good"]) if totals else (0, 0)
    if not n_bad or not n_good:
        counted.unpersist()
        sample.unpersist()
        return Lexicon({}, [], (-1.0, 0.0, 0.0))
    ratio = ((F.col("bad") + 0.1) / n_bad) / ((F.col("good") + 0.5) / n_good)
    chance = float(np.log(max(1, counted.count()))) + MARGIN
    best = counted.where((F.col("stem") != "") & (F.col("bad") >= MIN_DOCS)).select("stem", (F.col("bad") * F.log(ratio)).alias("evidence"), ratio.alias("ratio"))
    best = best.where((F.col("ratio") >= MIN_RATIO) & (F.col("evidence") >= chance))
    rows = best.groupBy(F.substring("stem", 1, MIN_STEM)).applyInPandas(_best_of_each_beginning, "stem string, ratio double").collect()
    stems = {r["stem"]: float(np.log(r["ratio"])) for r in sorted(rows)}
    counted.unpersist()
    phrases = _by_label(sample.mapInArrow(_learned_exceptions(stems), "toxic int, phrase string, n long"), "phrase")
    learned = [r["phrase"] for r in phrases.where("good >= 5 AND good > 2 * bad").collect()] if stems else []
    rough = Lexicon(stems, sorted({*learned, *EXCEPTIONS}), (0.0, 1.0, 1.0))
    shared = labelled.sparkSession.sparkContext.broadcast((rough.stems, rough.exceptions))
    schema = pa.schema([("toxic", pa.int32()), ("a", pa.float64()), ("b", pa.float64())])

    def features(batches):
        lexicon = Lexicon(*shared.value, (0.0, 1.0, 1.0))
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], schema=schema)

    points = sample.mapInArrow(features, "toxic int, a double, b double").toPandas().sort_values(["a", "b", "toxic"])
    sample.unpersist()
    return Lexicon(rough.stems, rough.exceptions, _curve(points[["a", "b"]].to_numpy(), points["toxic"].to_numpy()))


def scored(spark: SparkSession, lexicon: Lexicon, text: Column) -> Column:
    shared = spark.sparkContext.broadcast((lexicon.stems, lexicon.exceptions, lexicon.curve))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Lexicon(*shared.value)
        for texts in batches:
            yield pd.Series(own.score(texts.tolist()))

    small_batches(spark)
    return run(text)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    lexicon = fit(labelled_sample(docs, labels))
    return docs.select("doc_id", held.alias("held_out"), scored(spark, lexicon, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
