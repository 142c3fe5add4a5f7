"""Benchmark decontamination by template canonicalisation, in SQL functions alone.

Texts are canonicalised: numbers, units after numbers, and names (capitalised
words) become typed placeholders that carry the replaced
value, everything else is lower-cased words. A number is one value with its decimal
and thousands marks and its fraction bar; number words count as numbers, but for `one`,
which is mostly none. Every window of WINDOW words of every
document is hash-joined with the benchmark's windows on the template alone, so a
question asked again with other numbers, names or units still meets its item.

A capitalised word after a lower-case word is a name. In any other place (the
beginning of a sentence or line, after a comma, quote, number or full stop) it may be
one: documents have both forms of such a window, with all of these words as names and
with none; item windows have every choice. Pairs are judged with the first kind of
document windows and without, so that a changed first word that is no name loses none.

A (text, item) pair is a leak if the windows found cover at least COVERAGE of
the item's windows and the slots are consistent: each benchmark value is always
replaced by one value. Where slots disagree, only windows without any slot, or with
unchanged values, count. This is judged for each occurrence of the item in the
document (windows at one shift, document place minus item place; and windows at
neighbouring shifts, as values of several words move what follows) and for the pair
as a whole, whose windows may be scattered; the best of these counts, so an item
asked twice with different values is met. Texts that share a doc_id are judged apart.

Items shorter than WINDOW words use one window of their own length, with at least
MIN_WORDS words. The benchmark side is broadcast only if its windows, counted
first, number at most BROADCAST_WINDOWS; beyond that the join shuffles both sides.
The join's key is one whole number, the hash of the template's words; templates are compared after it.

Edge cases: null or empty texts and items match nothing; a null doc_id or item_id
is a value of its own; repeated documents are told apart by nothing and give one
row; repeated windows count once; empty tables give an empty result; other
columns are ignored, and pass through the stage; a text's words are held at once,
in three forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

WINDOW = 8
MIN_WORDS = 4
COVERAGE = 0.5
#: At about 250 bytes a window, 64 MB.
BROADCAST_WINDOWS = 250_000

#: The units that count as such after a number.
UNITS = "km|m|cm|mm|mi|miles?|meters?|metres?|feet|ft|inch(?:es)?|kg|g|mg|lbs?|pounds?|tons?|l|ml|liters?|litres?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|kmh|mph|degrees?"
#: Words that are numbers.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
#: Every placeholder begins with _SLOT, then its type: one search tells whether a window has any.
_SLOT, _NUM, _NAME, _UNIT = "\ue000", "\ue000\ue001", "\ue000\ue002", "\ue000\ue003"
_PLACEHOLDER = "\ue000[\ue001-\ue003]"
#: Stands before a word that may be a name.
_SOFT = "\ue005"
#: A decimal or thousands mark, so that a number is one value.
_POINT = "\ue004"


def canonical(text: Column) -> Column:
    """Words separated by one space; a placeholder is its marks and the value that it stands for.

    A word that may be a name has _SOFT before it.
    """
    marked = F.regexp_replace(text, r"\p{Lu}(?=\p{Ll})(?<![\p{L}\p{M}].)", f"{_SOFT}$0")
    marked = F.regexp_replace(marked, rf"{_SOFT}(?<=\p{{Ll}} .)", _NAME)
    marked = F.regexp_replace(marked, r"[.,/](?<=\d.)(?=\d)", _POINT)
    marked = F.regexp_replace(marked, rf"(\d[\d{_POINT}]*)(?: ?(%|{UNITS})(?![\p{{L}}\p{{N}}]))?", f" {_NUM}$1 {_UNIT}$2 ")
    marked = F.replace(marked, F.lit(f"{_UNIT} "), F.lit(""))
    return F.trim(F.regexp_replace(F.lower(marked), r"[^\p{L}\p{N}%\ue000-\ue005]+", " "))


def with_numbers(canonical_: Column) -> Column:
    """Canonical text with number words as numbers, and one space after the last word."""
    numbers = NUMBER_WORDS.split()
    some = [*numbers, *(_SOFT + w for w in numbers)]  # one lookup for each word
    words = F.transform(F.split(canonical_, " "), lambda w: F.when(w.isin(*some), F.concat(F.lit(_NUM), F.replace(w, F.lit(_SOFT), F.lit("")))).otherwise(w))
    return F.concat(F.array_join(words, " "), F.lit(" "))


def template(window: Column) -> Column:
    return F.when(F.contains(window, F.lit(_SLOT)), F.regexp_replace(window, rf"({_PLACEHOLDER})[^ ]*", "$1")).otherwise(window)


def slots(window: Column) -> Column:
    found = F.regexp_extract_all(window, F.lit(rf"({_PLACEHOLDER}[^ ]*)"), F.lit(1))
    return F.when(F.contains(window, F.lit(_SLOT)), found).otherwise(F.array().cast("array<string>"))


def windows_of(text: Column, words: int) -> Column:
    """All windows of so many words of a canonical text, in order; none if it has fewer."""
    # Each match takes one word and looks ahead for the rest, so windows overlap.
    return F.regexp_extract_all(text, F.lit(rf"(?=((?:[^ ]+ ){{{words}}}))[^ ]+ "), F.lit(1))


def _choices(window: Column) -> Column:
    """The window's forms, each word that may be a name taken as one and as none."""
    head, first = rf"^([^{_SOFT}]*){_SOFT}", lambda v, to: F.regexp_replace(v, head, f"$1{to}")
    marks = F.regexp_extract_all(window, F.lit(f"({_SOFT})"), F.lit(1))
    return F.aggregate(marks, F.array(window), lambda got, _: F.concat(F.transform(got, lambda v: first(v, "")), F.transform(got, lambda v: first(v, _NAME))))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_key, w (its window length), at (the window's place), n (its windows), window, template and h, the template's hash.

    A window has the forms of _choices and one in lower case without names, so
    copies in another case or place are met too.
    """
    texts = benchmark.where(F.col("text").isNotNull()).select("item_id", F.xxhash64("text").alias("item_key"), "text")
    forms = texts.select("item_id", "item_key", F.explode(F.array_distinct(F.array(canonical(F.col("text")), canonical(F.lower("text"))))).alias("c"))
    items = forms.select("item_id", "item_key", with_numbers(F.col("c")).alias("c")).withColumn("words", F.size(F.split(F.trim("c"), " ")))
    w = F.least(F.col("words"), F.lit(WINDOW))
    some = F.when(F.col("words") >= WINDOW, windows_of(F.col("c"), WINDOW)).otherwise(F.array("c"))
    rows = items.where(F.col("words") >= MIN_WORDS).select("item_id", "item_key", w.alias("w"), F.greatest(F.lit(1), F.col("words") - WINDOW + 1).alias("n"), F.posexplode(some).alias("at", "window"))
    rows = rows.withColumn("window", F.explode(_choices(F.col("window"))))
    return rows.withColumn("template", template(F.col("window"))).distinct().withColumn("h", hashed(F.split("template", " "), F.lit(0), F.col("w")))


def hashed(words: Column, place: Column, w: Column) -> Column:
    """Hash of w words from place on."""
    at = [F.get(words, place + k) for k in range(WINDOW)]
    return F.xxhash64(*[x if k < MIN_WORDS else F.when(w > k, x) for k, x in enumerate(at)])  # nulls leave a hash as it is


def text_windows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, text_key, place, form, doc_window and dh (its template's hash) of every window of the texts.

    Templates are made of the text, not of each window. Hashes come from the words in place, so
    that a window is put together only where its hash is met.
    """
    text = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), canonical(F.col("text")).alias("c"))
    text = text.select("doc_id", "text_key", with_numbers(F.col("c")).alias("c"))
    plain, named = (template(F.replace("c", F.lit(_SOFT), F.lit(to))) for to in ("", _NAME))
    text = text.select("doc_id", "text_key", *[F.split(x, " ").alias(k) for k, x in (("words", F.col("c")), ("plain", plain), ("named", named))])
    # An item has one window length, so places need only be right among windows of one length.
    text = text.withColumn("w", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    # Outer, as a filter for empty arrays would make the words twice; there are none.
    found = text.select("*", F.posexplode_outer("plain").alias("place", "first")).where(F.col("place") + F.col("w") < F.size("plain"))  # what the last space ends is no word
    found = found.select("doc_id", "text_key", "words", "place", "w", *[hashed(F.col(k), F.col("place"), F.col("w")).alias(k) for k in ("plain", "named")])
    both = F.array("plain", F.when(F.col("named") != F.col("plain"), F.col("named")))
    found = found.select("doc_id", "text_key", "words", "place", "w", F.posexplode(both).alias("form", "dh")).where(F.col("dh").isNotNull())
    window = F.concat(F.array_join(F.slice("words", F.col("place") + 1, F.col("w")), " "), F.lit(" "))
    window = F.replace(window, F.lit(_SOFT), F.when(F.col("form") == 0, F.lit("")).otherwise(F.lit(_NAME)))
    return found.select("doc_id", "text_key", "place", "form", window.alias("doc_window"), "dh")


def occurrences(pairs: DataFrame) -> DataFrame:
    """Every row once for each group that it is judged in: its shift, its run of near shifts, its pair; each with and without form 1."""
    by_shift = Window.partitionBy("doc_id", "text_key", "item_id", "item_key").orderBy("shift")
    # Copies side by side are an item's length apart, so nearer shifts than half of it are one copy's.
    far = F.col("shift") - F.col("last") > (F.col("n") + F.col("w") - 1) / 2
    rows = pairs.withColumn("last", F.lag("shift").over(by_shift)).withColumn("run", F.count(F.when(far, 1)).over(by_shift))
    text, item, none = F.col("text_key"), F.col("item_key"), F.lit(None)

    def groups(forms: int) -> Column:
        keys = [(text, item, none), (text, item, F.col("shift")), (text, item, F.col("run"))]
        return F.array(*(F.struct(F.lit(3 * forms + kind).alias("kind"), *(k.cast("long").alias(f"k{i}") for i, k in enumerate(key))) for kind, key in enumerate(keys)))

    return rows.withColumn("occurrence", F.explode(F.when(F.col("form") == 0, F.concat(groups(1), groups(2))).otherwise(groups(2))))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id and best (coverage, n_windows, kept: less the changed slots) of every text that leaks an item."""
    items = cut(item_windows(benchmark.select("item_id", "text")), "items")
    lengths, n = [], 0
    for row in items.groupBy("w").count().collect():  # at most WINDOW rows
        lengths.append(row["w"])
        n += row["count"]
    found = text_windows(docs.select("doc_id", "text"), sorted(lengths) or [WINDOW])
    side = F.broadcast(items) if n <= BROADCAST_WINDOWS else items
    # Not ==, which would be a second key of the join, made for every window; this is looked at where hashes meet.
    met = found.join(side, F.col("dh") == F.col("h")).where(template(F.col("doc_window")).between(F.col("template"), F.col("template")))
    zipped = F.arrays_zip(slots(F.col("window")).alias("was"), slots(F.col("doc_window")).alias("now"))
    pairs = met.select("doc_id", "text_key", "item_id", "item_key", "w", "n", "at", "form", (F.col("place") - F.col("at")).alias("shift"), zipped.alias("slots")).distinct()
    value = F.transform("slots", lambda s: F.struct(s["was"].alias("was"), s["now"].alias("now")))
    unchanged = F.forall("slots", lambda s: s["was"] == s["now"])
    summed = occurrences(pairs).groupBy("doc_id", "text_key", "item_id", "occurrence").agg(
        F.max("n").alias("n"),
        F.size(F.collect_set("at")).alias("n_windows"),
        F.size(F.collect_set(F.when(unchanged, F.col("at")))).alias("n_same"),
        F.array_distinct(F.flatten(F.collect_set(value))).alias("slots"),
    )
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["was"])))
    counted = F.when(consistent, F.col("n_windows")).otherwise(F.col("n_same"))
    changed = F.size(F.filter("slots", lambda s: s["was"] != s["now"]))
    passed = summed.withColumn("coverage", counted / F.col("n")).where(F.col("coverage") >= COVERAGE)
    best = F.max(F.struct("coverage", counted.cast("long").alias("n_windows"), (-changed).alias("kept")))
    return passed.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_windows, changed_slots of every leak, a row for each pair of ids."""
    return (
        judged(docs, benchmark)
        .groupBy("doc_id", "item_id")
        .agg(F.max("best").alias("best"))
        .select("doc_id", "item_id", "best.coverage", "best.n_windows", (-F.col("best.kept")).alias("changed_slots"))
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts that leak an item go, and no other text of the same doc_id."""
    doc, key = fresh(docs, "leak_doc"), fresh(docs, "leak_text")
    found = judged(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")
