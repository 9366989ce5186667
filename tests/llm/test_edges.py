"""Odd rows through every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import pytest
from emberline.llm import credentials, exact_dedup, langid, neardup, packing, pieces, quality, tokenfile, toxicity, warc, wordbpe
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, v long, n long, rep long, mark string, key string, rank long, part int, keep_id string, group_size string, score string, kept string, id string, host string, l_label string, f_id string"
PAD = ("x", 1, 2, 3, "y", "z", 4, 5, "k", "g", "s", "t", "i", "h", "l", "f")
ROWS = [
    (1, "one two three four five six seven", "en", "a.org", 33),
    (2, None, "en", "a.org", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "fr", "", 4),
    (5, "one  two three four five six seven", "en", "a.org", 34),
    (5, "one  two three four five six seven", "en", "a.org", 34),
    (6, LONG, "la", "b.org", len(LONG)),
    (None, "one two three four five six seven", "en", "a.org", 33),
    (7, "épée 日本語 🙂   word", "fr", "c.org", 17),
    (8, "hi", None, "c.org", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + PAD for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "z"), (1, 0, 0, "z"), (6, None, None, "z"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, text string")


def ids(df, column="doc_id"):
    return sorted((r[column] is not None, r[column] or 0) for r in df.select(column).collect())


WANT = sorted((r[0] is not None, r[0] or 0) for r in ROWS)


def test_exact_dedup(docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(docs).collect()}
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == WANT
    by = {r.doc_id: r for r in rows}
    assert (by[5].keep_id, by[5].group_size, by[5].kept, by[1].kept, by[None].kept) == (1, 4, False, True, False)
    assert by[2].keep_id == by[3].keep_id == 2 and by[2].group_size == 2 and by[4].group_size == 1  # white space is one space
    assert len(got) == 9


def test_secrets(docs):
    rows = credentials.find_secrets(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == WANT
    assert all(r.spans == "" for r in rows)
    clean = credentials.redact(docs)
    assert clean.schema == docs.schema and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))


def test_quality(docs, labels):
    rows = quality.apply_rules(docs, labels).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == WANT
    by = {r.doc_id: r for r in rows}
    assert (by[2].n_words, by[2].base_failed, by[2].kept) == (0, True, False)
    assert by[6].n_words == 100_000 and by[6].n_repeat_words == 100_000 and by[6].base_failed


def test_language(docs):
    rows = langid.identify(langid.document_items(docs)).collect()
    assert sorted((r.id is not None, r.id or 0) for r in rows) == WANT
    by = {r.id: r for r in rows}
    assert all(by[k].lang == "und" and not by[k].kept for k in (2, 3, 4))
    assert by[6].lang == "la" and by[6].kept


def test_near_duplicates(docs):
    rows = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == WANT
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 1 and not by[5].kept and by[1].kept
    assert (by[2].n_shingles, by[2].component_id, by[2].kept) == (0, 2, True)
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert by[8].n_shingles == 1 and by[6].n_shingles == 5


def test_pieces(docs):
    rows = pieces.encode_documents(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == WANT
    assert all(r.round_trip for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}


def test_toxicity(docs, labels):
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == WANT
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_token_files(docs):
    rows = sorted(tokenfile.round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert {r.doc_id: r.n_tokens for r in rows}[2] == 1


def test_packing(docs):
    rows = packing.pack(docs).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.doc_id, []).append(r.length)
    library = wordbpe.coder(wordbpe.default_path()).library
    assert sum(sizes[6]) == len(library.encode(LONG, add_special_tokens=False).ids) + 1 and sorted(sizes[6], reverse=True)[-2] == packing.LIMIT
    assert sizes[2] == sizes[3] == [1] and len(sizes[5]) == 2


def test_pages(spark):
    html = "<html lang='en'><p>" + "a" * 200
    rows = [(1, None, None, "p"), (2, "http://x.org/\r\nbad: é", html, "p"), (3, "u", html, "p"), (None, "u", html, "p"), (2, "u", html, "p"), (4, "u", "", "p"), (5, "u", "ab\x00\r\n\r\ncd", "p"), (6, "u", "b" * 3_000_000, "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (r.page_id is not None, r.page_id or 0))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(None, "revisit", 2), (1, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 2), (4, "response", None), (5, "response", None), (6, "response", None)]
    assert [r.payload_bytes for r in got] == [219, 0, 219, 219, 219, 0, 9, 3_000_000]
    assert {r.id for r in langid.identify(langid.page_items(pages)).collect()} == {None, 1, 2, 3, 4, 5, 6}


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert credentials.find_secrets(none).count() == credentials.redact(none).count() == 0
    assert quality.apply_rules(none, no_labels).count() == 0
    assert langid.identify(langid.document_items(none)).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert pieces.encode_documents(none).count() == 0
    assert toxicity.score(none, toxicity.fit(none, no_labels)).count() == 0
    assert tokenfile.round_trip(none).count() == 0
    assert packing.pack(none).count() == 0
    assert warc.round_trip(pages).count() == 0


def test_no_labels(docs, labels):
    rows = quality.apply_rules(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()}) == 1


def test_no_declared_languages(docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang for r in langid.identify(langid.document_items(bare)).collect()} == {"und"}
