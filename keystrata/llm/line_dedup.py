"""Substring dedup by hashing runs of lines and sentences.

A document's units are its lines and, in a line of several sentences, those: a
passage set into the middle of a paragraph is found by the sentences that it brings
whole. A unit is normalised (white space to one space, trimmed, lower-cased).
Length is judged on runs: from each unit forward, and from each backward,
consecutive units are joined, over line breaks too, up to MIN_WORDS words. A line or
sentence of MIN_WORDS words is a run by itself; lines, paragraphs and passages of
shorter units are runs together. Where words have no blanks between them, two
characters count as a word and sentences end at their own full stops too.

Runs are digested (128 bits) and digests are grouped over the whole corpus. The
earliest occurrence, by (doc_id, text, place), stays; all units of every other are
removed, with their offsets in the original text kept.

Texts are read once and give a narrow row for each run. Digests that are met once
only drop out by a count, which is combined before it is shuffled; the rest is joined
with each digest's earliest place, from tables that let Spark split a digest that a
third of the documents share. Texts move once, and only when they are rewritten.

Edge cases: null and empty texts have no units and come back as they are; a run
repeated inside one document keeps its first place; rows with equal doc_id and
equal text are the same occurrence (rows that share only the doc_id are not); a
null doc_id sorts last; a line that loses all its sentences goes; a text that loses
every unit becomes the empty string; memory is bounded by the longest text; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh, releasing, small_batches, table

#: Runs of fewer words stay.
MIN_WORDS = 8

_SENTENCE = re.compile(r"(?<=[.!?] )|(?<=[。！？])")
_SENTENCES = re.compile(r"[.!?] .|[。！？]")
_ODD = re.compile(r"[\t\r\f\x0b]|  ")
_SPACES = re.compile(r"[ \t\r\f\x0b]+")
#: Scripts that set no blanks between words: Han, Hiragana, Katakana, Thai, Lao, Khmer, Myanmar.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


def lines_of(text: str) -> list[list[str]]:
    """The sentences of each line, each with the space after it: together they are the line."""
    return [_SENTENCE.split(line) if _SENTENCES.search(line) else [line] for line in text.split("\n")]


def normalised(part: str) -> str:
    if _ODD.search(part):
        part = _SPACES.sub(" ", part)
    return part.strip(" ").lower()


def n_words(norm: str) -> int:
    blanks = norm.count(" ") + 1
    return blanks if norm.isascii() else max(blanks, len(_UNSPACED.findall(norm)) // 2)


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end (code points) and normalised text of each unit that has any."""
    at = 0
    for parts in lines_of(text):
        for part in parts:
            end = at + len(part)
            if norm := normalised(part):
                yield at, end, norm
            at = end
        at += 1


def runs(words: list[int]) -> list[tuple[int, int]]:
    """(first unit, one past the last) of the shortest runs of MIN_WORDS from each unit forward and backward."""
    n, out = len(words), []
    for i in range(n):
        total, j = words[i], i + 1
        while total < MIN_WORDS and j < n:
            total += words[j]
            j += 1
        if total >= MIN_WORDS:
            out.append((i, j))
        if words[i] < MIN_WORDS:
            total, j = words[i], i
            while total < MIN_WORDS and j:
                j -= 1
                total += words[j]
            # One that falls short without its last unit is a forward run too.
            if total >= MIN_WORDS and total - words[i] >= MIN_WORDS:
                out.append((j, i + 1))
    return out


def packed(places: list[tuple[int, int]]) -> bytes:
    """(start, end) of units in order, as differences of seven bits a byte: a few bytes for each."""
    out, before = bytearray(), 0
    for start, end in places:
        for x in (start - before, end - start):
            while x > 127:
                out.append(x & 127 | 128)
                x >>= 7
            out.append(x)
        before = end
    return bytes(out)


def unpacked(data: bytes) -> list[tuple[int, int]]:
    out, at, x, shift = [], 0, 0, 0
    start = None
    for b in data:
        x |= (b & 127) << shift
        shift += 7
        if b < 128:
            at += x
            if start is None:
                start = at
            else:
                out.append((start, at))
                start = None
            x = shift = 0
    return out


RUNS = "d1 long, d2 long, doc_id long, text_key long, unit int, spans binary"


def _run_rows(batches):
    """For each run its digest, the number of its first unit, and the places of its units."""
    for b in batches:
        digests, owner, first, spans = [], [], [], []
        for row, text in enumerate(b.column(2).to_pylist()):
            found = list(units(text))
            for i, j in runs([n_words(u[2]) for u in found]):
                inside = found[i:j]
                digests.append(xxhash.xxh3_128_digest("\n".join([u[2] for u in inside]).encode("utf-8", "surrogatepass")))
                owner.append(row)
                first.append(i)
                spans.append(packed([u[:2] for u in inside]))
        if owner:
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), b.column(0).take(at), b.column(1).take(at), pa.array(first, pa.int32()), pa.array(spans, pa.binary())],
                names=["d1", "d2", "doc_id", "text_key", "unit", "spans"],
            )


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("null_last"), "doc_id", "text_key", "unit")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, unit, spans and first_doc_id of every run that is not the earliest of its digest."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = cut(rows.mapInArrow(releasing(_run_rows), RUNS), "runs")
    # Tables, not subplans: a join right above an aggregate would tie a digest's rows to one task.
    often = cut(found.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("d1").alias("often")), "often")
    again = cut(found.join(often, F.col("d1") == F.col("often"), "left_semi"), "again")
    groups = again.groupBy("d1", "d2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = cut(groups.select(F.col("d1").alias("g1"), F.col("d2").alias("g2"), "first"), "groups")
    for done in (found, often):
        drop_cut(done)
    later = again.join(groups, (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2"))).where(_place() != F.col("first"))
    return later.select("doc_id", "text_key", "unit", "spans", F.col("first.doc_id").alias("first_doc_id"))


def _single(batches):
    """One row for each unit that any of a text's runs removes."""
    names = ["doc_id", "text_key", "start", "end", "first_doc_id"]
    for b in batches:
        owner, starts, ends, firsts = [], [], [], []
        for row, found in enumerate(b.column(2).to_pylist()):
            best: dict[tuple[int, int], int | None] = {}
            for run in found:
                doc = run["first_doc_id"]
                for place in unpacked(run["spans"]):
                    known = best.get(place)
                    best[place] = doc if known is None or (doc is not None and doc < known) else known
            owner += [row] * len(best)
            starts += [x[0] for x in best]
            ends += [x[1] for x in best]
            firsts += best.values()
        at = pa.array(owner, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(x, pa.int64()) for x in (starts, ends, firsts)]], names=names)


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end, first_doc_id of each removed unit (code points from 0, end exclusive); the first document of those that its runs are met in."""
    # A set: rows that are repeated any number of times give one.
    found = repeats(docs).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("spans", "first_doc_id")).alias("found"))
    return found.mapInArrow(releasing(_single), "doc_id long, text_key long, start long, end long, first_doc_id long")


def without(text: str, cuts: set[int]) -> str:
    """The text without the units that are cut; a line that loses all its parts goes."""
    out, k = [], 0
    for parts in lines_of(text):
        kept = []
        for part in parts:
            if normalised(part):
                if k not in cuts:
                    kept.append(part)
                k += 1
            else:
                kept.append(part)
        if kept:
            out.append("".join(kept))
    return "\n".join(out)


def dedup_runs(docs: DataFrame) -> DataFrame:
    """docs' rows with two more columns, `kept_text` and `n_removed` (units that were cut), or longer names if those are taken."""
    kept, removed = fresh(docs, "kept_text"), fresh(docs, "n_removed")
    ids = [fresh(docs, x) for x in ("cut_doc", "cut_key", "cuts")]
    cuts = repeats(docs).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("unit", "spans")).alias("cuts"))
    cuts = cuts.toDF(*ids)
    same = docs["doc_id"].eqNullSafe(F.col(ids[0])) & (F.xxhash64(docs["text"]) == F.col(ids[1]))
    joined = docs.join(cuts, same, "left").drop(*ids[:2])
    place, n, names = docs.columns.index("text"), len(docs.columns), [*docs.columns, kept, removed]

    def rewritten(batches):
        for b in batches:
            texts, counts = [], []
            for text, spans in zip(b.column(place).to_pylist(), b.column(n).to_pylist(), strict=True):
                gone = {run["unit"] + k for run in spans or () for k in range(len(unpacked(run["spans"])))}
                texts.append(without(text, gone) if gone else text)
                counts.append(len(gone))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, b.column(place).type), pa.array(counts, pa.int32())], names=names)

    schema = docs.withColumns({kept: F.col("text"), removed: F.lit(0)}).schema
    return joined.mapInArrow(releasing(rewritten), schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each removed unit: document, place in the original text, and the document that keeps the passage."""
    return removed_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated runs of units, n_chars as they are now; a document that loses every unit goes."""
    done = dedup_runs(docs)
    kept, removed = done.columns[-2:]
    emptied = (F.col(removed) > 0) & (F.trim(kept) == "")
    left = done.where(~F.coalesce(emptied, F.lit(False))).withColumn("text", F.col(kept))
    if dict(docs.dtypes).get("n_chars") == "bigint":
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.drop(kept, removed)


SQL = {
    "op8_substring_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT doc_id, i, COALESCE(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start,
    string_split(regexp_replace(line, '([.!?] |[。！？])', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM l
), e AS (
  SELECT doc_id, i, line_start, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM p
), o AS (
  SELECT doc_id, i, j, part, line_start + COALESCE(sum(length(part)) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    lower(trim(regexp_replace(part, '[ \t\r\f\x0B]+', ' ', 'g'), ' ')) AS norm
  FROM e
), u AS (
  SELECT doc_id, start, start + length(part) AS stop, norm, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k,
    greatest(len(string_split(norm, ' ')), length(regexp_replace(norm, '[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}]', '', 'g')) // 2) AS words
  FROM o WHERE norm <> ''
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS total FROM u
), r AS (
  SELECT x.doc_id, x.k AS a, min(y.k) AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k AND x.k + {MIN_WORDS - 1} AND y.total - x.total + x.words >= {MIN_WORDS} GROUP BY 1, 2
  UNION
  SELECT x.doc_id, max(y.k) AS a, x.k AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k - {MIN_WORDS - 1} AND x.k AND x.total - y.total + y.words >= {MIN_WORDS} GROUP BY 1, 3
), d AS (
  SELECT r.doc_id, a, b, string_agg(norm, chr(10) ORDER BY k) AS digest FROM r JOIN u ON r.doc_id = u.doc_id AND k BETWEEN a AND b GROUP BY 1, 2, 3
), f AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, a) AS n, first_value(doc_id) OVER (PARTITION BY digest ORDER BY doc_id, a) AS first_doc_id FROM d
)
SELECT u.doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", min(first_doc_id) AS first_doc_id
FROM f JOIN u ON f.doc_id = u.doc_id AND k BETWEEN a AND b WHERE n > 1 GROUP BY 1, 2, 3
"""
}
