"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import byte_cnn, exact_dedup, html_wrappers, license_join, mixing, nbest, projection_neighbours, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 40_000 + "x" * 3_000
ROWS = [
    (1, "one two three four five", "en", "src1", 23),
    (2, "one two three four five", "en", "src1", 23),
    (3, None, None, None, None),
    (4, "", "de", "src2", 0),
    (5, LONG, "de", "src2", len(LONG)),
    (None, "no id at all", "en", None, None),
    (6, "repeated row", "en", "src3", 12),
    (6, "repeated row", "en", "src3", 12),
    (7, " \t\n ", "fr", "src4", 4),
    (8, "é ß 日本 ☃ 1d10t", "fr", "src4", 13),
]
LABELS = [(1, 1, 0), (2, 1, 0), (3, None, None), (5, 0, 1), (None, 1, 1), (8, 0, 1)]
NAMES = ["digest", "salt", "content", "leaf", "budget", "fp", "key", "u", "v", "label", "_key", "epoch", "host", "wrapper", "score", "tokens"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.withColumns({n: F.lit(1) for n in NAMES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("score", F.lit(2))


def operators(labels):
    return {
        "token_counts": token_counts.token_counts,
        "license_scan": license_join.license_scan,
        "exact_dedup": exact_dedup.exact_dedup,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "mix": lambda d: mixing.mix(d, mixing.tree(), mixing.target_weights(d)),
        "quality": lambda d: byte_cnn.quality(d, labels),
        "encode": nbest.encode,
        "simhash": simhash.simhash_components,
    }


@pytest.mark.parametrize("name", ["token_counts", "license_scan", "toxicity", "quality", "encode", "simhash"])
def test_one_row_for_each_input_row(docs, labels, name):
    got = operators(labels)[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", ["token_counts", "license_scan", "exact_dedup", "toxicity", "mix", "quality", "encode", "simhash"])
def test_empty_table(spark, docs, labels, name):
    assert operators(labels)[name](docs.limit(0)).collect() == []


def test_empty_labels(docs, labels):
    none = labels.limit(0)
    assert all(r["score"] < 0.5 for r in toxicity.toxicity(docs, none).collect())
    assert byte_cnn.quality(docs, none).count() == len(ROWS)


def test_null_text_counts_as_empty(docs, labels):
    tokens = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    assert tokens[3]["n_tokens"] == tokens[4]["n_tokens"] == 0
    scan = {r["doc_id"]: r for r in license_join.license_scan(docs).collect()}
    assert (scan[3]["n_words"], scan[3]["labels"], scan[3]["score"], scan[3]["first_word"]) == (0, "", 0.0, None)
    copies = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert copies[4]["keep_id"] == 3 and copies[4]["group_size"] == 2 and not copies[4]["kept"]
    prints = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    assert prints[3]["fingerprint"] == prints[7]["fingerprint"] == "0" * 16 and prints[7]["component_id"] == 3
    pieces = {r["doc_id"]: r for r in nbest.encode(docs).collect()}
    assert pieces[3]["ids"] == [] and pieces[3]["n_best_scores"] == [0.0] and pieces[5]["round_trip"] and pieces[8]["round_trip"]


def test_ties_and_repeats_in_exact_dedup(docs):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(ROWS) - 1  # a row repeated whole is one document
    assert (got[2]["keep_id"], got[2]["kept"], got[6]["group_size"], got[6]["kept"]) == (1, False, 2, True)
    assert got[None]["kept"] and got[None]["keep_id"] is None


def test_stages_keep_columns_and_one_of_each(docs, labels, spark):
    for stage in (exact_dedup.keep_first_copies, simhash.keep_one_of_each, lambda d: mixing.keep_mixed(d, mixing.tree()), lambda d: toxicity.keep_clean(d, labels.limit(0))):
        assert stage(docs).columns == docs.columns
        assert stage(docs.limit(0)).collect() == []
    kept = [r["doc_id"] for r in exact_dedup.keep_first_copies(docs).collect()]
    assert sorted(kept, key=str) == [1, 3, 5, 6, 7, 8, None]
    near = [r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()]
    assert near.count(6) == 1 and 3 in near and 4 not in near and None in near


def test_pages(spark):
    rows = [(1, "http://a.org/x", None), (2, None, "<p>a &amp; b"), (None, "nonsense", ""), (3, "http://a.org/x", "<p>t</p>" * 5_000), (3, "http://a.org/x", "<p>t</p>" * 5_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit(2), "salt": F.lit(3)})
    got = {r["page_id"]: r for r in html_wrappers.main_text(pages).collect()}
    assert got[1]["text"] == "" and got[2]["text"] == "a & b" and got[None]["n_chars"] == 0
    assert got[3]["n_blocks"] == 5_000 and html_wrappers.main_text(pages).count() == 5
    assert html_wrappers.main_text(pages.limit(0)).collect() == []


def test_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (-4, [0.0, 3.0]), (10, [0.0, 3.0]), (11, [1e300, 1e300]), (12, [1e-300, 1e-300]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "rep": F.lit(1), "key": F.lit(1), "label": F.lit(1)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in projection_neighbours.near_vectors(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[None] == (2, 1, False)
    for alone in (3, 4, 5, 6, 7, 8, 9):
        assert got[alone] == (0, alone, True)
    assert got[-4] == (1, -4, True) and got[10] == (1, -4, False)
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    assert projection_neighbours.near_vectors(df.limit(0)).collect() == []


def test_deeply_nested_and_unclosed_tags(spark):
    deep = "<div>" * 5_000 + "<p>inside</p>" + "</div>" * 5_000
    rows = [(1, "http://a.org/1", deep), (2, "http://a.org/2", "<div><p>t" * 3_000), (3, "http://a.org/3", "<article>" + deep + "<nav>" + deep + "</nav></article>"), (4, "http://a.org/4", "<nav>" * 300 + "<p>menu</p>")]
    got = {r["page_id"]: r["text"] for r in html_wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[3] == "inside" and got[2].count("t") == 3_000 and got[4] == ""


def test_wrapper_does_not_grow_with_pages():
    def page(n):
        return f'<div id="post-{n}" class="post post-{n} entry big wide {"odd" if n % 2 else "even"}"><h1>title {n}</h1><p>text {n}</p></div>'

    now, size = None, []
    for n in range(3_000):
        own = (1, html_wrappers.pattern_of(html_wrappers.stream_of(page(n))))
        now = own if now is None else html_wrappers._merge_wrappers(now, own)
        size.append(len(str(now)))
    assert size[-1] <= size[10] + 10


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = projection_neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == [(1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (None, 2, 1, False)]


def test_level_values_with_slashes(spark):
    rows = [(i, "w " * 10, *[("a", "b/c", "d"), ("a", "b", "c/d"), ("a/b", "c", "d"), ("∅", "%2F", "/"), (None, "/", "%2F")][i % 5]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, y string, z string")
    got = mixing.mix(docs, {c: F.col(c) for c in "xyz"}, fraction=1.0, epochs=1).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(50)) and {(r["x"], r["y"], r["z"]): r["budget"] for r in got} == {k[2:]: 100.0 for k in rows}


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]
