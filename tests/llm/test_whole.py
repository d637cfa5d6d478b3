"""Each operator does its whole job: one test for each place where it once did less."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from framewright.llm import decontaminate, html, packing, tokens


@pytest.mark.parametrize("max_length", [2, 64])
def test_packing_keeps_the_text_and_counts_bpe_tokens(max_length, spark):
    texts = {1: "plain words in a row " * 20, 2: "東京都は日本の首都である" * 30, 3: "QUJD" * 400, 4: "", 5: "😀ünï" * 9, 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(docs, max_length=max_length, buckets=3, budget=128, vocabulary=tokens.VOCABULARY).collect()
    encoder = tokens.Encoder(tokens.load_ranks(tokens.VOCABULARY))
    for i, t in texts.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert "".join(r.text or "" for r in own) == (t or "") and (own[0].text is None) == (t is None)
        assert all((t or "")[r.char_start : r.char_end] == (r.text or "") and r.n_tokens <= max_length for r in own)
        assert sum(r.n_tokens for r in own) == len(encoder.spans(t or "")[0])
    batches = {}
    for r in rows:
        batches[r.bucket, r.batch] = batches.get((r.bucket, r.batch), 0) + r.padded_length
    assert max(batches.values()) <= 128


LINE, OTHER = "A long enough paragraph of text to surge over the line.", "Another long enough paragraph that says something else."
REFERENCES = "<ul>" + "<li><a href=x>A reference</a></li>" * 4 + "</ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{LINE}</p></article><article><p>{OTHER}</p></article>", f"{LINE} {OTHER}"),
        (f"<main><h1>Title</h1><p>Lead.</p><article><p>{LINE}</p></article></main>", f"Title Lead. {LINE}"),
        (f"<div><p>{LINE}</p>{REFERENCES}<p>{OTHER} And on.</p></div>", f"{LINE} {OTHER} And on."),
        (f"<div><p>{LINE}</p><p><a href=x>A link alone in its line</a></p><p>{OTHER}</p></div>", f"{LINE} A link alone in its line {OTHER}"),
        (f"<div class='layout has-sidebar'><article><p>{LINE}</p></article><div class=sidebar>{OTHER}</div></div>", LINE),
        (f"<div id=page class='no-sidebar'><p>{LINE}</p></div>", LINE), (f"<div class='layout sidebar-right'><article><p>{LINE}</p></article></div><p>Short</p>", f"{LINE} Short"),
        (f"<div><p>{LINE}</p></div><div class=comments><p>{OTHER * 9}</p></div>", LINE),
        (f"<p>{OTHER}</p><article><p>{LINE}</p></article>", f"{OTHER} {LINE}"),
        (f"<nav>Home</nav><section class='post search-friendly'><p>{LINE}</p></section><div class=comments><p>{OTHER * 9}</p></div>", LINE),
        (f"<table><tr><td><nav>{OTHER}</nav></td><td><p>{LINE}</p></td></tr></table><footer>{OTHER}</footer>", LINE),
        (f"<article><p>{LINE}</p><div class=notice>{OTHER}</div><div class='ad'>{OTHER}</div><p>{LINE}</p></article>", f"{LINE} {LINE}"),
        (f"<div role=navigation>{OTHER}</div><div role=main><p>{LINE}</p></div><div role=complementary>{OTHER}</div>", LINE),
    ],
)
def test_runs_that_are_kept(page, want):
    assert html.main_text(page) == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").is_dir(), reason="no test data")
def test_surge_and_dive_find_the_text_of_pages_without_articles():
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    same = sum(html.main_text(re.sub(r"(</?)article", r"\1div", p)) == html.main_text(p) for p in pages)
    assert same >= 0.99 * len(pages), same


def edited(text, rate, r):
    s = list(text)
    for _ in range(int(rate * len(s) + 1e-9)):
        k, o = r.randrange(len(s)), r.random()
        s[k : k + (o > 0.33)] = r.choice("abcdefghijklmnop ") if o < 0.67 else ""
    return "".join(s)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.18, 0.2])
@pytest.mark.parametrize("length", [10, 20, 31, 36, 64, 90, 230])
def test_items_with_edited_characters_are_found(length, rate):
    """Up to the stated similarity, in a language of few syllables."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(300)]
    items = [" ".join(r.choice(words) for _ in range(80))[:length].strip() for _ in range(100)]
    texts = ["some words before " + edited(t, rate, r) + " and some after" for t in items]
    index = decontaminate.Index(list(enumerate(items)))
    found = index.matches(texts, 0.8)
    assert sum(any(k in index.items[i][0] for i in f) for k, f in enumerate(found)) >= 0.93 * len(items)


def test_items_whose_blanks_are_gone_are_found():
    r = random.Random(3)
    items = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9))) for _ in range(30)) for _ in range(100)]
    found = decontaminate.Index(list(enumerate(items))).matches(["before it " + t.replace(" ", "") + " after it" for t in items], 0.8)
    assert all(k in f for k, f in enumerate(found))


def test_bounds_of_many_places_equal_the_distance():
    r = random.Random(5)
    items = ["".join(r.choice("abcd") for _ in range(r.randint(1, 64))) for _ in range(50)]
    text = "".join(r.choice("abcd") for _ in range(400))
    codes, begin, steps = decontaminate._codes(decontaminate._points(text)), np.array([r.randrange(-20, 400) for _ in items]), 70
    got = decontaminate.Pieces([decontaminate._codes(decontaminate._points(t)) for t in items]).least(codes, np.arange(50), begin, steps)
    assert got.tolist() == [decontaminate.edit_distance(t, text[max(0, b) : max(0, b + steps)])[0] for t, b in zip(items, begin.tolist(), strict=True)]


def test_items_with_one_text_are_reported_each(spark):
    item = "a passage of the benchmark that is long enough to be sampled by walks, twice in the table"
    docs, bench = spark.createDataFrame([(1, "so " + item + " it is")], "doc_id long, text string"), spark.createDataFrame([(7, item), (8, item), (8, item)], "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.matches(docs, bench).collect()) == [7, 8, 8]


@pytest.mark.parametrize(
    ("item", "text", "hit"),
    [
        ("short one", 'he said "short one", then left', True), ("short one", "a (short one). x", True), ("short one", "a shorx one here", True), ("one", "someone else", False), ("one", "that one.", True),
        ("日本の首都は東京です", "彼は日本の首都は東京ですと言った", True), ("日本の首都は東京です", "彼は犬が好きだと言った", False), ("a", "a", True), ("ab cd", "x abxcd y", True),
    ],
)
def test_short_items_are_held_by_edit_distance_between_word_ends(item, text, hit):
    assert bool(decontaminate.Index([(1, item)]).matches(["", text], 0.8)[1]) == hit


def test_items_without_spaces_are_found_in_running_text():
    r = random.Random(8)
    items = ["".join(chr(0x4E00 + r.randrange(2000)) for _ in range(100)) for _ in range(40)]
    other = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(333))
    found = decontaminate.Index(list(enumerate(items))).matches([other + t + other for t in items], 0.8)
    assert all(f.get(k, (1,))[0] == 0 for k, f in enumerate(found))


LONG_TEXTS = {"spaces": " " * 5_000_000, "feeds": "\n" * 5_000_000, "letters": "a" * 5_000_000, "mixed": "start" + " \n" * 2_000_000 + "end\t" + "　" * 10_000}


@pytest.mark.parametrize("tail", ["", "x", " x", "\nx", "\n", "7", "!"])
@pytest.mark.parametrize("run", [" ", "\n", " \n", "　\t", "\r\n"])
def test_long_white_space_gives_the_tokens_of_the_whole_encoding(run, tail):
    encoder = tokens.Encoder(tokens.load_ranks(tokens.VOCABULARY))
    for text in (run * 5_000 + tail, "word" + run * 5_000 + tail + run * 9_000 + tail, run * 10_000 + "\x1c" + run * 3_000 + tail):
        assert encoder.encode(text) == encoder.encoding.encode_ordinary(text)


def test_texts_of_millions_of_equal_characters_are_counted(spark):
    encoder = tokens.Encoder(tokens.load_ranks(tokens.VOCABULARY))
    docs = spark.createDataFrame(list(LONG_TEXTS.items()), "name string, text string").selectExpr("hash(name) doc_id", "text")
    got = tokens.token_counts(docs).selectExpr("doc_id", "n_tokens", "char_end - char_start AS n").groupBy("doc_id").sum("n_tokens", "n").collect()
    assert sorted((r[1], r[2]) for r in got) == sorted((len(encoder.encode(t)), len(t)) for t in LONG_TEXTS.values())


@pytest.mark.parametrize("page", ["<b>x</i>", "<i><p><b>x</i>", "<div class=ad>x", "<p><b>x", "</p>", "<a b='", '<a b="', "<li><b>x</p>", "<article><div class=note>"])
def test_a_megabyte_of_broken_markup_takes_seconds(page):
    import time

    began = time.time()
    html.main_text(page * (1_000_000 // len(page)))
    assert time.time() - began < 10


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<p>{LINE}</p><p><a href="foo>link</a> {OTHER}</p>', f"{LINE} link {OTHER}"),
        (f'<p>{LINE}</p><p><a href="foo>link</a> {OTHER} <a href="bar">two</a></p>', f"{LINE} link {OTHER} two"),
        (f"<p title='a > b' class=\"x\">{LINE}</p>", LINE),
        (f"<p title=don't>{LINE} It's here.</p>", f"{LINE} It's here."),
        (f"<p class=\"a\"id=\"b\">{LINE}</p>", LINE),
    ],
)
def test_unclosed_quotes_hide_no_text(page, want):
    assert html.main_text(page) == want


def test_preferences_with_clashing_columns_and_long_texts(spark):
    from framewright.llm import chat

    long = "word " * 400_000
    turns = spark.createDataFrame([(0, 0, "user", long), (0, 1, "assistant", "yes"), (1, 0, "user", long), (1, 1, "assistant", "no")], "conv_id long, turn long, role string, text string")
    for clash in ("turns", "pair_id", "prompt", "chosen"):
        turns = turns.withColumn(clash, turns["role"])
    (row,) = chat.preferences(turns).collect()
    assert row.n_prompt_turns == 1 and long in row.prompt and "yes" in row.chosen and "no" in row.rejected and long not in row.chosen


def test_rows_without_ids_spread_over_cells(spark):
    docs = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('text ', id) AS text")
    rows = packing.pack(docs, max_length=16, buckets=1, budget=64).collect()
    assert len(rows) == 400 and len({(r.bucket, r.batch, r.slot) for r in rows}) == 400


def test_one_key_with_half_of_all_rows_is_dealt_into_parts(spark):
    """No task of the joins with a key's minimum reads more than a part of the key."""
    from framewright.llm import common

    edges = spark.range(20_000).selectExpr("IF(id % 2 = 0, 1, id) AS a", "id + 5 AS b")
    found = common.with_least(edges, "a", "b", "m")
    assert found.where("a = 1").select("m").distinct().collect() == [(5,)] and found.count() == 20_000
    largest = found.where("a = 1").withColumn("part", common.part_of("b")).groupBy("part").count().agg({"count": "max"}).first()[0]
    assert largest < 3 * 10_000 / common.PARTS
    assert "__fw_part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_matches_do_not_depend_on_segments(monkeypatch):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(200)]
    items = [" ".join(r.choice(words) for _ in range(30)) for _ in range(60)]
    index = decontaminate.Index(list(enumerate(items)))
    text = " ".join(" ".join(r.choice(words) for _ in range(20)) + " " + edited(t, 0.1, r) for t in items * 6)
    whole = index.matches([text, None, ""], 0.8)
    assert set(whole[0]) == set(range(60)) and whole[1:] == [{}, {}]
    monkeypatch.setattr(decontaminate, "CHUNK", 1000)
    monkeypatch.setattr(decontaminate, "SEGMENT", 2000)
    assert index.matches([text, None, ""], 0.8) == whole


def test_runs_equal_brute_force():
    """A line is in a run if a surge point stands at or before it with no block without text between."""
    r = random.Random(4)
    for _ in range(300):
        lengths = [r.choice([0, 0, 0, 5, 20, 45, 90]) for _ in range(r.randint(0, 25))]
        block = [sum(lengths[k : k + html.WINDOW]) for k in range(len(lengths))]
        want = {k for s, n in enumerate(lengths) if n and block[s] >= html.SURGE for k in range(s, len(lengths)) if all(block[s : k + 1])}
        assert {k for a, b in html.runs(lengths) for k in range(a, b)} == want


def test_a_hot_id_is_dealt_into_ranges_and_rows_form_one_ring(spark):
    """Half of the rows without an id, a third with one id: each row's next is another row, in one ring by falling id."""
    from framewright.llm import minhash

    rows = [(None, f"none {k}") for k in range(300)] + [(7, f"seven {k}") for k in range(200)] + [(k, f"own {k}") for k in range(20, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = minhash.with_next(docs, lambda d: d.withColumn("more", minhash.F.upper("text")), {"text": "after", "more": "more_after"})
    got = {r.text: (r.doc_id, r.after, r.more_after) for r in found.collect()}
    assert len(got) == 600 and all(m == a.upper() for _, a, m in got.values())
    at, ring = "own 119", []
    for _ in range(600):
        ring.append(at)
        at = got[at][1]
    assert at == "own 119" and len(set(ring)) == 600
    assert [t.split()[0] for t in ring] == ["own"] * 100 + ["seven"] * 200 + ["none"] * 300 and ring[:100] == [f"own {k}" for k in reversed(range(20, 120))]
