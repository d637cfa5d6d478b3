"""Every operator and stage with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest

import corpus_pipeline
from framewright.llm import chat, decontaminate, html, minhash, packing, secrets, simhash, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and another word " * 20_000


def rows():
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(12)]
    out = [(k, t, "en", "src", len(t)) for k, t in enumerate(texts)]
    out += [(20, None, None, None, None), (21, "", "en", "src", 0), (22, "  \t\n", "en", "src", 4), (23, "one", "en", "src", 3), (24, LONG, "en", "src", len(LONG)), (25, texts[0], "en", "src", len(texts[0]))]
    out += [(26, "ünï ✓ 😀 " * 3, "xx", "", 24), (None, "no id here at all", "en", "src", 17), out[3], out[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), DOCS)
    for clash in ("fingerprint", "component_id", "score", "start", "bucket", "fp", "next_text", "candidate", "count", "row", "digest"):
        df = df.withColumn(clash, df["source"])
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, int(k == 1)) for k in range(12)] + [(None, 1, 1), (7, 1, None), (7, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'clash' AS text", "1 AS words", "2 AS score")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, rows()[5][1][:200]), (2, None), (3, ""), (4, "short one"), (1, rows()[5][1][:200])], "item_id long, text string").selectExpr("*", "item_id AS doc_id", "1 AS distance")


@pytest.fixture(scope="module")
def trees(spark):
    return secrets.train(spark)


def operators(spark, labels, benchmark, trees):
    return {
        "tokens": tokens.token_counts, "fields": lambda d: tokens.token_counts(d, ["lang", "text", "source"]), "simhash": simhash.near_duplicates, "toxicity": lambda d: toxicity.toxicity(d, labels),
        "matches": lambda d: decontaminate.matches(d, benchmark), "minhash": minhash.edited_fingerprints, "secrets": lambda d: secrets.scan(d, trees), "packing": packing.pack,
    }


#: Operators with one row for each input row.
WHOLE = ("simhash", "toxicity", "minhash")


@pytest.mark.parametrize("name", ["tokens", "fields", "simhash", "toxicity", "matches", "minhash", "secrets", "packing"])
def test_documents(name, spark, docs, labels, benchmark, trees):
    run = operators(spark, labels, benchmark, trees)[name]
    got = run(docs).collect()
    ids = [r.doc_id for r in got]
    if name in WHOLE:
        assert sorted(ids, key=str) == sorted((r[0] for r in rows()), key=str)
    if name == "matches":
        assert {(r.doc_id, r.item_id) for r in got} == {(5, 1)} and len(got) == 2
    if name in ("tokens", "fields", "packing"):
        assert set(ids) == {r[0] for r in rows()}
    assert run(docs.where("false")).collect() == []
    few = [r.doc_id for r in run(docs.where("doc_id is null or text is null")).collect()]
    assert set(few) == ({None, 20} if name in (*WHOLE, "tokens", "fields", "packing") else set())


@pytest.mark.parametrize("k", range(5))
def test_stages(k, spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    if k < 4:
        assert out.columns == docs.columns
    out = out.collect()
    assert out and (k != 3 or len(out) == len(rows()))
    assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_empty_labels_and_benchmark(spark, docs, labels, benchmark):
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert decontaminate.matches(docs, benchmark.where("false")).collect() == []
    assert decontaminate.without_matches(docs, benchmark.where("false")).count() == len(rows())


def test_pages(spark):
    big = "<p>" + "text " * 30 + "</p>"
    p = spark.createDataFrame([(2, "u", big), (1, "http://h/x y\r\n?q", big), (None, None, big), (3, "u", None), (4, "u", ""), (5, "u", "<p>é</p>"), (6, "u", "<p>é</p>"), (2, "u", big)], "page_id long, url string, html string").withColumn("digest", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = html.extract(p).collect()
    assert len(got) == 8 and {r.page_id: r.text for r in got}[3] == ""
    w = warc.round_trip(p).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in w) == sorted(
        [(False, 1, "response", None, len(big)), (False, 2, "revisit", 1, len(big)), (False, 2, "revisit", 1, len(big)), (True, 0, "revisit", 1, len(big)), (False, 3, "response", None, 0), (False, 4, "response", None, 0), (False, 5, "response", None, 9), (False, 6, "response", None, 9)], key=lambda r: (r[0], r[1])
    )
    assert html.extract(p.where("false")).collect() == [] and warc.round_trip(p.where("false")).collect() == []


def test_conversations(spark):
    t = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", None), (0, 1, "assistant", None), (1, 0, "user", "a"), (1, None, None, "x"), (None, 0, "user", "lost"), (4, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.preferences(t).collect()}
    assert set(got) == {0, 2} and got[2].rejected is None and got[2].chosen_id == 4 and got[0].n_prompt_turns == 0
    assert chat.preferences(t.where("false")).collect() == []
