import pytest
from emberline.operators import basins, cochange, drift, graph, heat, literal_index, provenance, reveal
from emberline.sources import extract, files
from emberline.streaming import ledger
from pyspark.sql import functions as F


def test_literal_weights(spark):
    rows = [("a.go", 1, "/users/:id", 1), ("b.ts", 1, "/users/{id}", 2), ("c.py", 1, "/users/${id}", 3), ("a.go", 2, "/users/:x", 1), ("a.go", 3, "DB_URL", 1), ("b.ts", 3, "DB_URL", 2), ("z", 1, "ok", 4)]
    sites = spark.createDataFrame([(f, n, t, node, k) for k, (f, n, t, node) in enumerate(rows)], "file string, line int, text string, node long, pos int")
    occ = literal_index.occurrences(sites).cache()
    keys = {r.key: r for r in literal_index.keys(occ).collect()}
    assert {k: (r.cls, r.df) for k, r in keys.items()} == {"/users/{*}": ("path", 3), "DB_URL": ("env", 2)}
    edges = {(r.a, r.b): r.w for r in literal_index.edges(occ, literal_index.keys(occ)).collect()}
    assert set(edges) == {(1, 2), (1, 3), (2, 3)}
    assert edges[(1, 2)] == pytest.approx(max(keys["/users/{*}"].w, keys["DB_URL"].w))


def test_cochange_gate_and_keeper(spark):
    rows = [(1, "2024-01-01", f) for f in "ab"] + [(2, "2024-01-02", f) for f in "ab"] + [(3, "2024-01-03", f"x{k}") for k in range(25)] + [(4, "2024-01-04", "a")]
    commits = spark.createDataFrame(rows, "commit long, ts string, file string").withColumn("ts", F.to_timestamp("ts"))
    got = cochange.pairs(commits).collect()
    assert [(r.a, r.b, r.n, r.solo_a, r.solo_b) for r in got] == [("a", "b", 2, 2, 2)]
    assert got[0].w == pytest.approx(0.5)
    old = F.lit("2030-01-01").cast("timestamp")
    assert cochange.partner_seeds(cochange.both_ways(cochange.pairs(commits)), spark.createDataFrame([("a",)], "file string"), old).count() == 0


def test_star_has_no_region(spark):
    e = spark.createDataFrame([(k, 0, k + 1, "invokes", 1.0) for k in range(5)], "pos long, a long, b long, kind string, w double")
    near = basins.ends(e)
    assert basins.candidates(near, heat.degrees(heat.adjacency(e))).count() == 0


def one_after_the_other(ways, seeds, n):
    """Regions by the rule, seed by seed, over plain dictionaries."""
    total = {i: sum(w for _, w in x) for i, x in ways.items()}
    taken, regions = set(), []
    for seed in seeds:
        if len(regions) == basins.MOST_REGIONS or seed in taken:
            continue
        own, inside = [seed], 0.0
        while True:
            met, border = {}, {}
            for k, m in enumerate(own):
                for j, w in ways[m]:
                    if j not in own:
                        border[j] = border.get(j, 0.0) + w
                        met.setdefault(j, k)
            if len(own) >= basins.MOST_MEMBERS or (len(own) >= basins.LEAST_MEMBERS and sum(border.values()) > basins.CUT * max(inside, 0.001)):
                break
            best = min(((-border[j] / total[j], met[j], j) for j in border if j not in taken), default=None)
            if best is None or -best[0] < basins.LEAST_RATIO:
                break
            inside += border[best[2]]
            own.append(best[2])
        if basins.LEAST_MEMBERS <= len(own) <= max(40, n / 3):
            taken.update(own)
            regions.append(own)
    return regions


def test_regions_grown_side_by_side_are_those_grown_in_turn(spark, monkeypatch):
    """Overlapping clusters, so that regions of one batch clash."""
    import random

    monkeypatch.setattr(basins, "BATCH", 4)
    rng = random.Random(5)
    edges = [(a, b, rng.choice((0.5, 1.0)) if a // 6 == b // 6 else 0.25) for a in range(36) for b in range(a + 1, 36) if rng.random() < (0.8 if a // 6 == b // 6 else 0.1)]
    e = spark.createDataFrame([(k, a, b, "invokes", w) for k, (a, b, w) in enumerate(edges)], "pos long, a long, b long, kind string, w double")
    near = basins.ends(e).cache()
    scored = basins.candidates(near, heat.degrees(heat.adjacency(e))).cache()
    ways = {}
    for a, b, w in edges:
        ways.setdefault(a, []).append((b, w))
        ways.setdefault(b, []).append((a, w))
    want = one_after_the_other(ways, [r.i for r in scored.orderBy(F.desc("score"), "i").collect()], 36)
    got = {}
    for r in sorted(basins.grow(near, scored, 36).collect(), key=lambda r: r.place):
        got.setdefault(r.seed, []).append(r.member)
    assert len(want) > 2 and got == {x[0]: x for x in want}


def test_budget_is_never_exceeded(spark):
    items = spark.createDataFrame([(k, "x" * (10 + k)) for k in range(1, 60)], "rank long, line string")
    for budget in (16, 64, 300, 5000):
        got = reveal.fitting(items, 20, 80, 30, budget).where("shown").collect()
        left = 80 - len(got)
        size = 20 + sum(len(r.line) + 1 for r in got) + (30 + len(str(left)) if left else 0)
        assert not got or -(-size // 4) <= budget
        assert sorted(r.rank for r in got) == list(range(1, len(got) + 1))


def test_enclosing_takes_the_last_start(spark):
    symbols = spark.createDataFrame([("f", 3, 10, 0), ("f", 3, 11, 1), ("f", 9, 12, 2)], "file string, line int, idx long, pos long")
    sites = spark.createDataFrame([(1, "f", 2), (2, "f", 3), (3, "f", 8), (4, "f", 9), (5, "g", 5)], "site long, file string, line int")
    assert {r.site: r.idx for r in graph.enclosing(sites, symbols).collect()} == {1: None, 2: 11, 3: 11, 4: 12, 5: None}


def test_refresh_extracts_only_what_changed(spark):
    cached = spark.createDataFrame([("a", "1", 5), ("b", "1", 6)], "file string, sha string, n int")
    current = spark.createDataFrame([("a", "1", "xx"), ("b", "2", "yyy"), ("c", "1", "z")], "file string, sha string, text string")
    asked = []

    def extractor(df):
        asked.append(sorted(r.file for r in df.collect()))
        return df.select("file", "sha", F.length("text").alias("n"))

    assert sorted(map(tuple, files.refresh(cached, current, extractor).collect())) == [("a", "1", 5), ("b", "2", 3), ("c", "1", 1)]
    assert asked == [["b", "c"]]


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules" / "b.js").write_text("1")
    (tmp_path / "c.so").write_text("1")
    got = files.read_tree(spark, str(tmp_path)).collect()
    assert [(r.file, r.size, r.text) for r in got] == [("src/a.py", 6, "x = 1\n")]


def test_broken_python_has_no_symbols(spark):
    df = spark.createDataFrame([("a.py", "def f(:\n"), ("b.py", None), ("c.py", "class A:\n  def m(self): pass\n")], "file string, text string")
    assert sorted(r.name for r in extract.symbols(df).collect()) == ["A", "A.m"]


def test_provenance_of_nothing(spark):
    none = spark.createDataFrame([], "file string, kind string")
    assert provenance.overall(none).first().kind == "unattributed"


def test_ping_pong_is_silent_after_the_first_charge(spark):
    memory = spark.createDataFrame([], "key string, m double")
    warmed = spark.createDataFrame([("k", "f", 0.4, ["call dependency"])], "key string, file string, m double, r array<string>")
    known = spark.createDataFrame([], "file string")
    fired = []
    for _ in range(5):
        deltas = drift.surprise(warmed, memory, known)
        total = deltas.agg(F.sum("delta")).first()[0]
        fired.append(total > 0.15)
        memory = spark.createDataFrame(drift.charge(memory, deltas, total > 0.15).collect(), "key string, m double")
    assert fired == [True, False, False, False, False]


CHARGES = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-03 01:00:00", 1.0), ("b", "2024-01-01 00:00:00", 0.5)]


def test_stream_equals_batch(spark, tmp_path):
    charges = spark.createDataFrame(CHARGES, "key string, at string, mass double").withColumn("at", F.to_timestamp("at"))
    charges.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledger.ledger_stream(spark.readStream.schema(charges.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("ledger").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.key, r.at, round(r.surprise, 9)) for r in rows)
    batch = key(ledger.ledger_batch(charges).collect())
    assert key(spark.sql("select * from ledger").collect()) == batch
    assert [round(s, 6) for k, _, s in batch if k == "a"] == [1.0, round(1 - 0.5 ** (1 / 48), 6), 0.5]


def test_watermarked_sums(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:20:00", "x", 2.0), ("2024-01-01 09:00:00", "x", 5.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ledger.hourly(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hourly").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.n, r.mass) for r in spark.sql("select * from hourly").collect()] == [(2, 3.0)]


def test_verdict_per_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", "semantic")], "file string, status string")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = ledger.verdict_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b, i: seen.append((i, b.count())), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen == [(0, 1)]


def test_texts_that_are_hard_to_split(spark):
    """Null and empty texts have no facts; long strings and comments, closed or not, need no stack, and change no line."""
    big = 300_000
    texts = [None, "", '"' + "\\n" * big + '"\nrun(1)', "/*" + "x\n" * big + "*/ run(2)", "/*" + "y" * big, "'" * big, "`" + "z\n" * big + "`;run(3)"]
    df = spark.createDataFrame([(f"f{k}.ts", t) for k, t in enumerate(texts)], "file string, text string")
    assert sorted(map(tuple, extract.calls(df).collect())) == [("f2.ts", 2, "run"), ("f3.ts", big + 1, "run"), ("f6.ts", big + 1, "run")]
    assert extract.imports(df).count() == extract.anchors(df).count() == extract.symbols(df).count() == 0
    none = extract.stripped(df.where("text is not null")).where("size(split(text, '\n')) <> size(split(code, '\n')) or size(split(text, '\n')) <> size(split(bare, '\n'))")
    assert none.count() == 0
