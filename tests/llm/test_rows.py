"""Rows are judged each, whatever their ids: repeated ids with different texts, ties, and the pipeline over odd rows."""

import re

import corpus_pipeline
import pytest
from emberline.llm import credentials, neardup, wordbpe
from emberline.llm.common import ROW, cut, numbered, only
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_numbers_belong_to_rows(spark, tmp_path):
    spark.range(1000).select("id", F.lit("x").alias(ROW[:5])).repartition(7).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    first = {r.id: r[ROW] for r in numbered(t).collect()}
    assert len(set(first.values())) == 1000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        assert {r.id: r[ROW] for r in numbered(t.where("id % 3 = 0").select("id")).collect()} == {k: v for k, v in first.items() if k % 3 == 0}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    twice = numbered(t.unionByName(t))
    assert twice.columns == [*t.columns, ROW] and twice.select(ROW).distinct().count() == 2000


@pytest.mark.parametrize("masks_bytes", [0, 1 << 26])
def test_only_the_wanted_rows(spark, masks_bytes):
    rows = [0, 1, 7, 8, 32767, 32768, 65535, (1 << 40) + 5, (5 << 40) + 40_000]
    df = spark.createDataFrame([(r, str(r), 1) for r in rows], "n long, t string, __emberline_part int")
    wanted = spark.createDataFrame([(r,) for r in (0, 8, 32768, (1 << 40) + 5, 3, None)], "w long")
    got = only(df.select("n", "t"), "n", wanted, masks_bytes)
    assert sorted(map(tuple, got.collect())) == sorted((r, str(r)) for r in (0, 8, 32768, (1 << 40) + 5))


WORDS = [f"w{k}" for k in range(80)]
TEXT = " ".join(WORDS[:60])


def test_near_duplicates_of_repeated_ids(spark):
    other = " ".join(WORDS[20:])
    rows = [(5, other), (5, TEXT + " z"), (7, other + " q"), (9, TEXT), (5, ""), (5, ""), (None, TEXT), (4, "alone here")]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"), "rows")
    x = numbered(docs)
    texts = x.select(F.col(ROW).alias("n"), "text")
    got = [(r.doc_id, r.text, r.component_id, r.kept, r.group) for r in neardup.near_duplicates(x, row=ROW).join(texts, F.col(ROW) == F.col("n")).collect()]
    by = {(i, t): (c, k) for i, t, c, k, _ in got}
    assert by == {(5, other): (5, True), (7, other + " q"): (5, False), (5, TEXT + " z"): (5, True), (9, TEXT): (5, False), (5, ""): (5, True), (None, TEXT): (None, True), (4, "alone here"): (4, True)}
    group = {(i, t): g for i, t, _, _, g in got}
    assert group[(5, other)] == group[(7, other + " q")] != group[(5, TEXT + " z")] == group[(9, TEXT)]
    assert group[(5, "")] is None and group[(None, TEXT)] is None


def plain(rows):
    """Exact and near dedup of (doc_id, text) rows in order, by brute force."""
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    best = {}
    for k in sorted(range(len(rows)), key=order):
        best.setdefault(key(rows[k][1]), k)
    stay = sorted(best.values())
    exact = [rows[k] for k in stay]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []) for w in ((t or "").lower().split() for _, t in exact)]
    root = list(range(len(exact)))
    for a in range(len(exact)):
        for b in range(a):
            if exact[a][0] is not None and exact[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    first = {}
    for k in sorted(range(len(exact)), key=lambda k: (exact[k][0] is None, exact[k][0] or 0, k)):
        first.setdefault(root[k], k)
    near = [exact[k] for k in sorted(first.values())]
    return exact, near


ROWS = [(1, "aa bb"), (1, "aa bb"), (2, "aa  bb"), (3, "x y"), (3, "aa bb"), (None, "aa bb"), (None, "only here"), (None, "only here"), (4, None), (5, ""), (6, TEXT), (6, TEXT + " more"), (7, TEXT.upper()), (8, TEXT + " end of it"), (9, " ".join(WORDS[20:])), (6, " ".join(WORDS[20:]) + " too")]


def odd(spark, rows):
    """As documents, with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", "a.org", len(t or ""), "k", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, `row` long, `group` int, text_sha256 int")


def test_dedup_stages_on_odd_rows(spark):
    docs = cut(odd(spark, ROWS).coalesce(1), "odd")
    want_exact, want_near = plain(ROWS)
    show = lambda df: sorted(map(repr, df.select("doc_id", "text").collect()))
    told = lambda rows: sorted(repr(r) for r in spark.createDataFrame(rows, "doc_id long, text string").collect())
    exact = cut(corpus_pipeline.exact(spark, docs, SF), "exact")
    assert exact.columns == docs.columns and show(exact) == told(want_exact)
    near = corpus_pipeline.near(spark, exact, SF)
    assert near.columns == docs.columns and show(near) == told(want_near)
    clean = corpus_pipeline.secrets(spark, near, SF)
    assert show(clean) == show(near)
    library = wordbpe.coder(wordbpe.default_path()).library
    assert sum(r.length for r in corpus_pipeline.pack(spark, clean, SF).collect()) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in want_near)


def test_stages_on_empty_tables(spark):
    docs = odd(spark, ROWS).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF), "stage")
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns


def test_language_stage_rejects_foreign_text_and_gibberish(spark):
    """Whatever fits none of the languages goes, and clean documents stay."""
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    russian = "в начале было слово и слово было у всех людей города которые шли домой после долгого дня " * 3
    chinese = "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待" * 4
    gibberish = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(80))
    foreign = [(10**9 + k, t, tag, "x.org", len(t)) for k, (t, tag) in enumerate([(russian, None), (chinese, None), (gibberish, None), (russian, "en"), (gibberish, "fr"), ("12 34 --", "en"), ("", "en"), (None, None)]) for t in [t or ""]]
    mixed = cut(docs.unionByName(spark.createDataFrame(foreign, docs.schema)), "mixed")
    kept = corpus_pipeline.language(spark, mixed, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_redaction_is_what_the_scan_finds(spark):
    text = "x password=abcdefgh0123 y"
    docs = spark.createDataFrame([(1, text), (1, None)], "doc_id long, text string")
    assert {r.text for r in credentials.redact(docs).collect()} == {credentials.masked(text, credentials.scan(text)[1]), None}
