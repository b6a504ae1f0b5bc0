"""Very long texts go through whole, and rows without an id keep their rows."""

import re

from pyspark.sql import functions as F

from skeinwork.llm import html, licences, ngram_join, packing, quality, spotsigs, urls

LONG = " ".join(f"word{i % 5000} and the {i}" for i in range(70_000)) + "\nend #"
ROWS = [(1, LONG, "en", "s"), (2, LONG + " more", "en", "s"), (None, "a short text of the one kind", "en", None), (None, None, None, None), (3, " \t\n", "de", "s")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_ngram_join_of_long_texts(spark):
    got = {r["doc_id"]: r for r in ngram_join.query(docs(spark)).collect() if r["doc_id"]}
    for i, text, *_ in ROWS[:2]:
        w = [x.lower() for x in words(text)]
        assert got[i]["n_shingles"] == len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) and got[i]["component_id"] == 1
    assert got[3]["n_shingles"] == 0 and ngram_join.query(docs(spark)).count() == len(ROWS)


def test_counts_of_long_texts(spark):
    got = quality.query(docs(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    for i, text, *_ in ROWS[:2]:
        assert (by[i]["n_words"], by[i]["word_chars"], by[i]["n_symbols"]) == (len(words(text)), sum(map(len, words(text))), len(re.findall("[#*$%&|<>]", text)))


def test_licences_fingerprints_and_pieces_of_long_texts(spark):
    assert licences.query(docs(spark)).count() == len(ROWS)
    prints = spotsigs.query(docs(spark)).collect()
    assert len(prints) == len(ROWS) and {r["n_chars"] for r in prints} == {len(t or "") for _, t, *_ in ROWS}
    pieces = packing.query(docs(spark)).where("doc_id = 1").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.max("piece").alias("last")).first()
    assert pieces["n"] == pieces["end"] > 4096 * pieces["last"] > 100_000


def test_pages_without_an_id(spark):
    page = "<html><body><nav>menu</nav><article><p>" + "word " * 300_000 + "</p></article></body></html>"
    rows = [(None, "http://a.example/x", page, 1), (5, None, None, 2), (None, None, "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r["page_id"] or r["url"]: (r["text"], r["n_chars"]) for r in html.query(pages).collect()}
    assert got["http://a.example/x"] == (("word " * 300_000).strip(), 1_499_999) and got[5] == ("", 0)
    host, path = urls.parts(F.col("url"))
    assert sorted((r[0], r[1]) for r in pages.select(host, path).collect()) == [("", ""), ("", ""), ("a.example", "/x")]
