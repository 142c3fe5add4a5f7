import random
import zlib

import pytest
from pyspark.sql import functions as F

from keystrata.llm import decontam as D
from keystrata.llm import langid as L
from keystrata.llm import line_dedup as N
from keystrata.llm import toxicity as T

WORDS = {
    "en": "the of and to in that with was this from have which there their would about".split(),
    "de": "der die und das ist nicht mit auf für sich eine werden über können straße".split(),
    "fr": "le la les et des est pas dans pour une avec être été élève français".split(),
}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(4)
    rows = [(k, prose(r, lang, r.randint(1, 80)), lang) for k in range(300) for lang in [r.choice(list(WORDS))]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 ... 456", "de"), (903, "der und " * 60_000, None), (None, "the of and that", "en"), (1, rows[1][1], rows[1][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("s"), "p": F.lit(1)})


def test_language_contract(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 306 and got[0].asDict().keys() >= {"doc_id", "held_out", "lang_pred", "score"}
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (900, 901, 902))
    assert by_id[903].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {r.doc_id: r.lang for r in documents.collect() if r.lang and r.text and len(r.text) > 20}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 900]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def grams(text, buckets):
    """Buckets of a text's 1- to 3-grams, by plain Python."""
    low = "".join(c if c.isalpha() else " " for c in text.replace("Σ", "σ").lower())
    cps = [0, 0, *map(ord, " " + " ".join(low.split()) + " ")] if low.strip() else []
    out, mask = [], 0xFFFFFFFF
    for k in range(2, len(cps)):
        one = cps[k] * 0x9E3779B1 & mask
        two = (one ^ (cps[k - 1] * 0x85EBCA77 + 1 & mask)) * 0xC2B2AE3D & mask
        three = (two ^ (cps[k - 2] * 0x27D4EB2F + 2 & mask)) * 0x165667B1 & mask
        out += [x >> (33 - buckets.bit_length()) for x in (one, two, three)]
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 17, 500, 1 << 19])
def test_language_pieces_lose_nothing(monkeypatch, chunk):
    import numpy as np

    r = random.Random(chunk)
    texts = ["Der Ärger, und 12 die Straße ist über allem. " * 40, "", None, "12", "ΑΣ σ", "İx", "é" * 30]
    texts += ["".join(r.choice("abcΣσ ß12İ,é") for _ in range(r.randint(0, 80))) for _ in range(40)]
    w = np.random.default_rng(0).normal(size=(1 << 12, 3)).astype(np.float32)
    monkeypatch.setattr(L, "CHUNK", chunk)
    sums, counts = L.log_likelihoods(texts, w)
    for t, got, n in zip(texts, sums, counts, strict=True):
        want = grams(t or "", 1 << 12)
        assert n == len(want) and np.allclose(got, w[want].astype(float).sum(0) if want else 0, atol=1e-3)


def test_language_query_matches_brute_force(spark, documents, tmp_path):
    import math
    from collections import Counter

    documents.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    n, docs = {}, Counter()
    for d, t, lang in rows:
        if not held(d) and t is not None and lang is not None:
            docs[lang] += 1
            n.setdefault(lang, Counter()).update(grams(t, L.MAX_BUCKETS))
    total = {k: sum(c.values()) + L.SMOOTHING * L.MAX_BUCKETS for k, c in n.items()}
    want = []
    for d, t, _ in rows:
        found = Counter(grams(t or "", L.MAX_BUCKETS))
        count = sum(found.values())
        if not count:
            want.append((str(d), "und", 0.0))
            continue
        scale = min(1.0, L.CERTAIN_AFTER / count)
        logits = {k: scale * (math.log(docs[k] / docs.total()) + sum(x * math.log((n[k][g] + L.SMOOTHING) / total[k]) for g, x in found.items())) for k in sorted(n)}
        best = max(logits, key=logits.get)
        want.append((str(d), best, 1 / sum(math.exp(v - logits[best]) for v in logits.values())))
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in L.op1_language_id(spark, str(tmp_path)).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4


def test_many_languages(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"wort{chr(97 + k % 26)}{chr(97 + k // 26)} " * 9, f"l{k}") for k in range(300)], "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "MATRIX_CELLS", 1 << 19)
    model = L.fit(df)
    assert len(model.languages) == 300 and len(model.weights) == 1 << 10
    monkeypatch.setattr(L, "MATRIX_CELLS", 1 << 12)
    with pytest.raises(ValueError):
        L.fit(df)


def test_language_nothing_to_learn(spark, documents):
    model = L.fit(documents.where("lang IS NULL"))
    assert model.predict(["abc", None])[0] == ["und", "und"]
    kept = L.stage(spark, documents, "")
    assert kept.columns == documents.columns
    assert {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == 303
    empty = documents.where("doc_id = -1")
    assert L.stage(spark, empty, "").count() == 0


def test_folding():
    assert T.fold_text("1D10T l0ser p@thetic") == " idiot loser pathetic "
    assert T.fold_text("іdіоt 2024 x") == " idiot 2024 x "
    assert T.fold_text("Zero​Width  Été!") == " zerowidth été "
    assert T.fold_text("") == "  "


def toxic_rows(n=400):
    r = random.Random(8)
    bad = ["scumbag", "moronic", "Idiot", "1d1ot"]
    rows, labels = [], []
    for k in range(n):
        words = [r.choice(WORDS["en"]) for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(bad)
        elif k % 7 == 0:
            words[10:12] = ["idiot", "proof"]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_contract(spark, tmp_path):
    rows, labels = toxic_rows()
    rows += [(1000, None), (1001, ""), (1002, "the of and " * 60_000 + " ".join(["scumbag"] * 4)), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit(9), "lang": F.lit("en")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = T.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(by_id[k], t) for k, _, t in labels if by_id[k].held_out]
    assert sum(p.predicted == t for p, t in held) / len(held) > 0.95
    assert by_id[1000].predicted == by_id[1001].predicted == 0


def test_toxicity_exceptions_and_disguise():
    lex = T.Lexicon({"idiot": 2.0}, ["idiot proof"], (0.0, 1.0, 1.0))
    assert lex.weigh("an idiot proof lock")[:2] == (0, 0)
    assert lex.weigh("an idiot, an IDIOTIC thing; ídiot")[1] == 3
    assert lex.weigh(None) == (0.0, 0, 0)
    assert T.Lexicon({}, [], (-1.0, 0.0, 0.0)).score(["x", None]).max() < 0.5


@pytest.mark.parametrize("chunk", [1, 3, 7, 20, 50])
def test_toxicity_pieces_score_as_the_whole(monkeypatch, chunk):
    r = random.Random(chunk)
    lex = T.Lexicon({"idiot": 2.0, "trash": 1.5, "loser": 1.0}, ["trash can", "sore loser board", "idiot proof"], (0.0, 1.0, 1.0))
    parts = ["trash", "can", "idiot", "proof", "sore", "loser", "board", "ídiot", "x", "Ä", "1d1ot", "--"]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", "\n", "  ", ", ", "\t"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    whole = [lex.weigh(t) for t in texts]
    assert sum(w[1] for w in whole) > 500
    monkeypatch.setattr(T, "CHUNK", chunk)
    assert [lex.weigh(t) for t in texts] == whole


def brute_weight(lex, text):
    """Sum of weights by plain search in the folded words."""
    words = T.fold_text(text or "").split()
    harmless = set()
    for p in lex.exceptions:
        n = p.count(" ") + 1
        for k in range(len(words) - n + 1):
            if words[k : k + n] == p.split():
                harmless |= set(range(k, k + n))
    total = 0.0
    for k, w in enumerate(words):
        forms = [max((v for s, v in lex.stems.items() if w.startswith(s)), default=0.0)]
        if not w.isascii():
            forms.append(max((v for s, v in lex.stems.items() if s.isascii() and len(s) >= 5 and T.unaccented(w).startswith(s)), default=0.0))
        total += 0 if k in harmless else forms[0] or forms[-1]
    return total, len(words)


def test_toxicity_query_matches_brute_force(spark, tmp_path):
    import math

    rows, labels = toxic_rows()
    rows += [(1000, None), (1001, ""), (1003, "Ídiót trash can, MORONIC t3xt " * 50), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    taught = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    lex = T.fit(T.labelled_sample(docs, spark.createDataFrame(taught, "doc_id long, quality int, toxic int")))
    assert lex.stems
    bias, a, b = lex.curve
    want = []
    for d, t in rows:
        w, n = brute_weight(lex, t)
        want.append((d, 1 / (1 + math.exp(-(bias + a * math.log1p(w) + b * w / math.sqrt(n + 25))))))
    got = sorted((r.doc_id, r.score) for r in T.op2_toxicity(spark, str(tmp_path)).collect())
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-9 for x, y in zip(got, sorted(want), strict=True))


def test_toxicity_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert T.op2_toxicity(spark, str(tmp_path)).count() == 0


def test_toxicity_without_labels(spark):
    rows, _ = toxic_rows(20)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, toxic int")
    assert T.fit(df).stems == {} and T.fit(df.where("toxic = 1")).score(["moron"])[0] < 0.5


def test_line_dedup_same_id_other_text(spark):
    line = " ".join("abcdefgh")
    df = spark.createDataFrame([(1, line), (2, f"keep me\n{line}"), (2, "another text\nof this id")], "doc_id long, text string")
    done = sorted(x.kept_text for x in N.dedup_runs(df).collect())
    assert done == sorted([line, "keep me", "another text\nof this id"])


def brute_runs(rows):
    """Each (doc, text)'s text without the units of repeated runs, and (doc, start, end, first doc) of each removed unit."""
    import re

    places, texts, spans = {}, {}, {}
    for doc, text in sorted((r for r in set(rows) if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = [re.split(r"(?<=[.!?] )|(?<=[。！？])", line) for line in text.split("\n")]
        units, at = [], 0
        for i, line in enumerate(lines):
            for j, p in enumerate(line):
                units.append((i, j, " ".join(p.split()).lower()))
                spans[doc, text, (i, j)] = (at, at + len(p))
                at += len(p)
            at += 1
        units = [(u, len(re.findall(r"[\u3040-\u9fff]", u[2])) // 2) for u in units if u[2]]
        units = [(u, max(n, len(u[2].split(" ")))) for u, n in units]
        texts[doc, text] = lines
        for a in range(len(units)):
            for b in range(a, min(len(units), a + 20)):
                inside = units[a : b + 1]
                if sum(n for _, n in inside) < 8:
                    continue
                if sum(n for _, n in inside[1:]) < 8 or sum(n for _, n in inside[:-1]) < 8:
                    places.setdefault(tuple(u[2] for u, _ in inside), []).append((doc, text, [u[:2] for u, _ in inside]))
    cut = {}
    for met in places.values():
        for doc, text, us in met[1:]:
            for u in us:
                cut.setdefault((doc, text, u), []).append(met[0][0])
    left = {}
    for (doc, text), lines in texts.items():
        kept = [[p for j, p in enumerate(line) if (doc, text, (i, j)) not in cut] for i, line in enumerate(lines)]
        left[doc, text] = "\n".join("".join(k) for k in kept if k)
    first = lambda ids: min((x for x in ids if x is not None), default=None)
    return left, sorted(str((key[0], *spans[key], first(ids))) for key, ids in cut.items())


def test_line_dedup(spark, tmp_path):
    r = random.Random(6)
    lines = [prose(r, "de", r.randint(3, 20)) for _ in range(25)]
    passage = ". ".join(prose(r, "en", r.randint(5, 14)) for _ in range(6)) + ". "
    rows = [(k, "\n".join(r.choice(lines) if r.random() < 0.6 else prose(r, "fr", 12) + str(k) for _ in range(r.randint(1, 8)))) for k in range(80)]
    rows += [(100 + k, prose(r, "fr", 15) + f" {k}. " + passage + prose(r, "fr", 9) + f" {k}!") for k in range(5)]
    rows += [(200, None), (201, ""), (202, "  " + lines[0].upper() + "\t \n\n" + lines[0]), (203, "😀 " * 9 + "\n" + "😀 " * 9), (204, passage), (None, "\n".join(lines)), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"unit": F.lit("u"), "spans": F.lit(1), "d1": F.lit(2), "kept_text": F.lit("mine"), "n_removed": F.lit(7), "cuts": F.lit(0)})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    left, spans = brute_runs(rows)
    got = N.op8_substring_dedup(spark, str(tmp_path)).collect()
    assert sorted(str((x.doc_id, x.start, x.end, x.first_doc_id)) for x in got) == spans
    assert {x.doc_id for x in got} >= {101, 102, 103, 104, 204} and 100 not in {x.doc_id for x in got}
    done = N.dedup_runs(df).collect()
    assert len(done) == len(rows) and all(x.kept_text_ == left.get((x.doc_id, x.text)) and (x.kept_text, x.n_removed) == ("mine", 7) for x in done)
    kept = N.stage(spark, df, "")
    assert kept.columns == df.columns and {(x.kept_text, x.n_removed) for x in kept.collect()} == {("mine", 7)}
    assert N.dedup_runs(df.where("doc_id < 0")).count() == 0 and N.removed_spans(df.where("doc_id < 0")).count() == 0


def test_runs_of_short_units(spark):
    r = random.Random(9)
    notice = "\n".join(prose(r, "en", r.randint(1, 5)) + f" {k}" for k in range(20))
    verse = "".join(prose(r, "de", r.randint(2, 10)).capitalize() + f"{k}. " for k in range(12))
    chinese = "今天的天气非常好。我们一起去公园散步吧！晚上再回家吃饭。"
    short = [prose(r, "fr", r.randint(1, 4)) for _ in range(6)]
    rows = [(1, notice), (2, f"own words of two\n{notice}\nown end"), (3, verse), (4, f"Own start. {verse}Own end."), (5, chinese), (6, "我先说一句。" + chinese), (7, "two words\n\nin common"), (8, "two words\nin common")]
    rows += [(20 + k, r.choice(["\n", "\n\n", ". "]).join(r.choice(short) for _ in range(r.randint(1, 12)))) for k in range(30)] + [(None, verse), (90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left, _ = brute_runs(rows)
    done = {(x.doc_id, x.text): x.kept_text for x in N.dedup_runs(df).collect()}
    assert len(done) == len(rows) and all(v == left.get(k) for k, v in done.items())
    kept = {x.doc_id: x.text for x in N.stage(spark, df, "").collect()}
    assert kept[2] == "own words of two\nown end" and kept[4] == "Own start. Own end." and kept[6] == "我先说一句。"
    assert kept[8] == "two words\nin common" and None not in kept and kept[1] == notice and kept[3] == verse


def test_decontamination(spark):
    items = [(1, "Alice drove 120 km in 2 hours and then rested for 30 minutes before she drove back"), (2, "What is the capital of France?"), (3, None), (4, ""), (5, "tiny"), (6, "Compare the two 4 and 4 with one more number 5 in this long sentence of ours")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    filler = "some other words that nobody asked about at all "
    docs = [
        (1, filler * 3 + items[0][1].upper().lower() + ". " + filler),
        (2, filler + "Bob drove 90 miles in 3 hours and then rested for 45 minutes before she drove back"),
        (3, filler * 50_000),
        (4, "asked: what is the capital of france"),
        (5, None), (6, ""), (7, "tiny"),
        (8, "compare the two 7 and 7 with one more number 9 in this long sentence of ours"),
        (9, "compare the two 7 and 8 with one more number 9 in this long sentence of ours"),
        (10, items[0][1]), (10, items[0][1]), (None, items[0][1]),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()}
    assert {(1, 1), (2, 1), (4, 2), (8, 6), (10, 1), (None, 1)} <= got
    assert not {d for d, _ in got} & {3, 5, 6, 7}
    assert (9, 6) not in got  # one value became two
    changed = {r.doc_id: r.changed_slots for r in D.leaks(df, bench).collect()}
    assert changed[1] == 0 and changed[2] >= 3
    assert D.leaks(df.where("doc_id < 0"), bench).count() == 0 and D.leaks(df, bench.where("item_id < 0")).count() == 0


PENS = "If 900 pens cost 450 dollars how much does one pen cost?"


def met(spark, items, docs):
    """{doc: coverage} of the leaks of numbered items and documents."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {r.doc_id: r.coverage for r in D.leaks(df, bench).collect()}


def test_decontamination_judges_each_occurrence(spark):
    one, two = (PENS.replace("900", a).replace("450", b) for a, b in [("30", "60"), ("50", "80")])
    long = "Then Tom gave 5 apples to Ann and after that Tom gave 7 pears to Ann so how many does Tom have"
    wide = [long.replace("Tom", a).replace("5", b) for a, b in [("Mary Ann Lee", "8"), ("Bob", "9")]]
    got = met(spark, [PENS, long], [one, two, f"{one} {two}", f"{one}\n{'more words ' * 30}\n{two}", "so then " + wide[0] + ". " + wide[1], one.replace("one pen", "60 pens")])
    assert {k: got.get(k) for k in (0, 1, 2, 3)} == {0: 1, 1: 1, 2: 1, 3: 1}
    assert 4 in got and 5 not in got


def test_decontamination_whole_numbers(spark):
    steps = "Every step of the long stair rises 2 cm and all 40 steps together rise 80 cm"
    got = met(spark, [PENS, steps], [PENS.replace("450", "1,250"), PENS.replace("450", "12.50"), "here: " + steps.replace("2 cm", "2.5 cm").replace("80", "1.250,75")])
    assert got == {0: 1, 1: 1, 2: 1}
    c = spark.range(1).select(D.canonical(F.lit("v1.5, 3%. 7 km,8;9.x")).alias("c")).first().c
    assert c.split() == ["v", f"{D._NUM}1{D._POINT}5", f"{D._NUM}3", f"{D._UNIT}%", f"{D._NUM}7", f"{D._UNIT}km", f"{D._NUM}8", f"{D._NUM}9", "x"]


def test_decontamination_names_in_any_place(spark):
    apples = "Tom has 5 red apples. Tom buys 3 more. Tom eats 2 of them. How many apples does Tom have left?"
    doctor = 'Our street has two old doctors.\nSmith sees 5 ill people a day, "Smith" is a good man, Mr. Smith sees 3 more at night'
    ann = apples.replace("Tom", "Ann")
    docs = ["here it is. " + ann, "here it is: " + ann.replace(". How", "; how"), "it says " + ann + " Good.", "here. " + doctor.replace("Smith", "Jones") + " too", apples.lower(), apples.upper()]
    docs += ["here it is. " + ann.replace(". How", ". Say how"), "Tom has a cat. Ann has a dog. How many pets do they have now?"]
    got = met(spark, [apples, doctor], docs)
    assert {k: got.get(k) for k in range(6)} == dict.fromkeys(range(6), 1)
    assert got.get(6, 0) >= 0.5 and 7 not in got


def test_decontamination_first_words_that_are_no_names(spark):
    item = "If it rains 5 days the lake rises 7 cm over all. If it rains 9 days the lake rises by how much over all"
    assert met(spark, [item], [item.replace("If it rains 5", "When it rains 6")])[0] > 0.5


ASKED = {
    "A car travels 1,200 km in 8 hours at one speed. How far does it go in 3 hours?": "A car travels 900 km in 6 hours at one speed. How far does it go in 2 hours?",
    "Alice has 3 apples and gives 2 of them to a friend. How many apples does Alice have?": "Bob has 5 apples and gives 4 of them to a friend. How many apples does Bob have?",
    "The shop on our street closes early today. Carol buys 7 loaves of fresh bread there for the week": "The shop on our street closes early today. Dave buys 9 loaves of fresh bread there for the week",
    "A jug holds 3.5 liters and a cup holds 1/2 liters so how many cups fill the whole jug?": "A jug holds 12 liters and a cup holds 3 liters so how many cups fill the whole jug?",
    "Four pens and three books lie on the desk beside two lamps so how many things lie there": "Six pens and nine books lie on the desk beside 12 lamps so how many things lie there",
}


def test_decontamination_asked_again(spark):
    filler = "this page has some words of its own. "
    docs = [*ASKED, *ASKED.values(), *(filler * 3 + x + " and more words follow" for x in ASKED.values()), *(x.lower() for x in ASKED)]
    bench = spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate([*docs, filler * 9])), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()}
    assert got == {(k, k % len(ASKED)) for k in range(len(docs))}


def brute_words(text):
    """Words of a text as (type, value): n number, u unit, m name, s a word that may be a name, w other."""
    import regex

    out = []
    numbers = set(D.NUMBER_WORDS.split())
    for m in regex.finditer(r"(?P<n>\d(?:\d|[.,/](?=\d))*)(?: ?(?P<u>%|(?:" + D.UNITS + r")(?![\p{L}\p{N}])))?|(?P<w>[\p{L}%]+)", text):
        if m["n"]:
            out.append(("n", regex.sub("[.,/]", ".", m["n"])))
            if m["u"]:
                out.append(("u", m["u"].lower()))
            continue
        w, before = m["w"], text[max(0, m.start() - 2) : m.start()]
        if w.lower() in numbers:
            out.append(("n", w.lower()))
        elif regex.match(r"\p{Lu}\p{Ll}", w):
            out.append(("m" if regex.fullmatch(r"\p{Ll} ", before) else "s", w.lower()))
        else:
            out.append(("w", w.lower()))
    return out


def brute_leaks(items, docs):
    """(doc, item) pairs by comparing every window of one occurrence, word by word."""

    def alike(a, b):
        if a[0] == b[0] == "w" or "w" in (a[0], b[0]):
            return a[1] == b[1] and {a[0], b[0]} <= {"w", "s"}
        if "s" in (a[0], b[0]):
            return {a[0], b[0]} <= {"s", "m"}
        return a[0] == b[0]

    out = set()
    for i, item in enumerate(items):
        x = brute_words(item)
        w = min(len(x), D.WINDOW)
        n = len(x) - w + 1
        for d, doc in enumerate(docs):
            y = brute_words(doc)
            for shift in range(-n + 1, len(y)):
                met, values = set(), {}
                for at in range(n):
                    p = at + shift
                    if 0 <= p <= len(y) - w and all(alike(a, b) for a, b in zip(x[at : at + w], y[p : p + w], strict=True)):
                        met.add(at)
                        for a, b in zip(x[at : at + w], y[p : p + w], strict=True):
                            if a[0] != "w" and not (a[0] == "s" and a[1] == b[1]):
                                values.setdefault(a, set()).add(b[1])
                if len(met) >= D.COVERAGE * n and all(len(v) == 1 for v in values.values()):
                    out.add((d, i))
    return out


def test_decontamination_against_brute_force(spark):
    """Generated questions asked again with other numbers, names and units: nearly all that a plain matcher meets are met, clean texts never."""
    r = random.Random(12)
    names = "Ann Bob Carol Dave Eve Frank Gina Hugo Ida Jack".split()
    things = "apples pens books coins cards stamps marbles".split()
    verbs = "buys finds sells loses counts paints".split()
    number = lambda: r.choice([str(r.randint(2, 99)), f"{r.randint(1, 9)},{r.randint(100, 999)}", f"{r.randint(1, 9)}.{r.randint(1, 9)}", r.choice(D.NUMBER_WORDS.split()[:8])])
    shapes = [
        "{a} {v} {x} {t} at the old market near the river. {a} then gives {y} of the {t} to {b} before noon. How many {t} does {a} keep?",
        "In the morning {a} {v} {x} {t} and in the evening {b} {v} {y} more, so how many {t} do both of them have now",
        "A train with {x} {t} on board travels {y} km in {z} hours and stops at every small town on its long way",
        "Our teacher says that {a} {v} {x} {t} each week. After {y} weeks how many {t} has {a} got in the large blue box?",
    ]
    def fill(shape, thing, verb):
        a, b = r.sample(names, 2)
        return shape.format(a=a, b=b, v=verb, t=thing, x=number(), y=number(), z=number())

    made = [(shape, r.choice(things), r.choice(verbs)) for shape in shapes for _ in range(3)]
    items = [fill(*m) for m in made]
    filler = lambda: "".join(r.choice(["we went home then. ", "it was a long day for all of us. ", "some rain fell, "]) for _ in range(r.randint(0, 4)))
    docs = [filler() + fill(*m) + r.choice([" ", ". "]) + filler() for m in made for _ in range(3)]
    clean = [filler() * 3 + "the market has many apples and books" for _ in range(10)]
    want = brute_leaks(items, docs + clean)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs + clean)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.leaks(df, bench).collect()}
    own = {(d, d // 3) for d in range(len(docs))}
    assert len(want & got) >= 0.95 * len(want) and len(own & got) >= 0.9 * len(own)
    assert not [d for d, _ in got if d >= len(docs)]


def test_decontamination_stage_keeps_other_texts(spark, tmp_path):
    spark.createDataFrame([(1, PENS)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, PENS, 1), (None, "a clean text of its own", 1), (7, PENS.replace("900", "30"), 2), (7, "another clean text", 3), (8, None, 4), (9, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, leak_doc long").withColumns({"w": F.lit(1), "h": F.lit(2), "words": F.lit("x"), "leak_text": F.lit(0)})
    kept = D.stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(r[:2]) for r in rows if r[1] is None or "pens" not in r[1])


def test_decontamination_same_id_other_text(spark):
    df = spark.createDataFrame([(1, PENS.replace("900", "30")), (1, PENS.replace("900", "50"))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, PENS)], "item_id long, text string")
    assert [(r.coverage, r.n_windows, r.changed_slots) for r in D.leaks(df, bench).collect()] == [(1, 5, 1)]


def test_decontamination_shuffles_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    text = " ".join(f"word{chr(97 + k)}" for k in range(20))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(one, one.withColumnRenamed("doc_id", "item_id")).collect()] == [(1, 1)]


def test_decontamination_windows_of_several_lengths(spark):
    texts = ["Alpha beta two Gamma 5 km delta. Zeta eta theta iota, Kappa lambda mu nu xi", "one two three", "", "a b c d", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = {r.doc_id: r.c.split() for r in docs.where("text IS NOT NULL").select("doc_id", D.with_numbers(D.canonical(F.col("text"))).alias("c")).collect()}
    want = set()
    for doc, ws in words.items():
        for n in (4, 8):
            for k in range(len(ws) - n + 1):
                window = " ".join(ws[k : k + n]) + " "
                want |= {(doc, k, form, window.replace(D._SOFT, to)) for form, to in enumerate(("", D._NAME)) if not form or D._SOFT in window}
    got = D.text_windows(docs, [4, 8])
    assert len(want) > 20 and {(r.doc_id, r.place, r.form, r.doc_window) for r in got.collect()} == want
    w = F.size(F.split(F.trim("doc_window"), " "))
    assert got.where(F.col("dh") != D.hashed(F.split(D.template(F.col("doc_window")), " "), F.lit(0), w)).count() == 0


def test_decontamination_joins_on_the_hash_alone(spark):
    """The template is made where hashes meet, not for every window."""
    docs = spark.createDataFrame([(1, "what is the sum of all these many numbers here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "what is the sum of all these many numbers here")], "item_id long, text string")
    got = D.leaks(docs, bench)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [dh#" in plan
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1.0, 3, 0)]
