import os

import pytest

import corpus_pipeline as P
from keystrata.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs
    for name, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, DATA), name)
        assert docs.columns == first.columns
        assert docs.select("doc_id").subtract(first.select("doc_id")).count() == 0
    out = P.run(spark, DATA)
    assert 0 < out.count() == docs.count() <= first.count()
    assert out.where("NOT round_trip").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, DATA).toPandas()

    def rows(d):
        d = d[sorted(want.columns)]
        return sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="no model file here")
def test_pipeline_matches_brute_force(spark, tmp_path):
    """All five stages against plain Python, with null and repeated ids, copies and clashing columns."""
    import random

    import sentencepiece
    from test_jaccard import brute
    from test_texts import PENS, brute_leaks, brute_runs, prose

    from keystrata.llm import langid, spiece

    r = random.Random(31)
    say = lambda lang, n: " ".join(prose(r, lang, 9).capitalize() + f" {r.randint(100, 999)}x." for _ in range(n))
    langs = ["en", "de", "fr"]
    rows = [(k, say(langs[k % 3], r.randint(1, 8)), langs[k % 3]) for k in range(40)]
    passage = say("en", 3)
    rows += [(50 + k, say("en", 2) + " " + passage + " " + say("en", 2), "en") for k in range(3)]
    rows += [(60, rows[4][1], "de"), (61, rows[5][1] + " ende", "fr"), (62, rows[7][1], "de"), (63, passage, "en")]
    rows += [(70, say("en", 1) + "\n" + PENS.replace("900", "70"), "en"), (71, PENS, "en"), (None, say("fr", 2), "fr"), (None, PENS + " " + say("en", 1), "en")]
    rows += [(80, None, "en"), (81, "", "de"), (82, "12 34", "fr"), (3, say("de", 2), "de"), (3, rows[3][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars", "1 AS kept_text", "2 AS cuts", "3 AS leak_doc", "4 AS predicted")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PENS)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    names, scores = langid.fit(df).predict([t for _, t, _ in rows])
    left = [(i, t) for (i, t, _), name, score in zip(rows, names, scores, strict=True) if name != "und" and score >= langid.REJECT_BELOW]
    node = {i: c for i, _, c, _ in brute(left)}
    left = list(dict.fromkeys((i, t) for i, t in left if i is not None and node[str(i)] == str(i))) + [x for x in left if x[0] is None]
    texts, _ = brute_runs(left)
    left = [(i, texts[i, t]) for i, t in left if texts[i, t].strip()]
    leaked = {d for d, _ in brute_leaks([PENS], [t for _, t in left])}
    left = [x for k, x in enumerate(left) if k not in leaked]
    library = sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    got = sorted(str((x.doc_id, list(x.ids))) for x in P.run(spark, str(tmp_path)).collect())
    assert got == sorted(str((i, library.encode(t))) for i, t in left)
    assert 30 < len(got) < len(rows) - 8
