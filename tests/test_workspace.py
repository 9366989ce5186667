import pytest
from emberline.config import Config, applied
from emberline.plans.corpus import CORPUS
from emberline.sources import git
from emberline.sources.files import same_stat
from emberline.workspace import Workspace
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def space(spark):
    days = [(k, f"2024-01-0{k}", f) for k in (1, 2, 3) for f in ("web/client.ts", "lib/routes.rb")]
    commits = spark.createDataFrame(days, "commit long, ts string, file string").withColumn("ts", F.to_timestamp("ts"))
    return Workspace(spark.createDataFrame(list(CORPUS.items()), "file string, text string"), commits)


def test_graph(space):
    names = {r.i: r.id for r in space.graph.nodes.collect()}
    edges = {(names[r.a], names[r.b], r.kind) for r in space.graph.edges.collect()}
    assert ("file:web/orders.test.ts", "file:web/orders.ts", "tests") in edges
    assert ("file:web/orders.ts", "file:web/client.ts", "imports") in edges
    assert ("file:web/orders.test.ts", "loadOrder@web/orders.ts", "invokes") in edges
    assert ("Report.build@jobs/report.py", "send@jobs/mail.py", "invokes") in edges
    assert ("anchor:GET /orders/{*}", "loadOrder@web/orders.ts", "anchors") in edges
    joined = {frozenset(e[:2]) for e in edges if e[2] == "join"}
    assert frozenset(("KEY@jobs/report.py", "file:deploy/app.yaml")) in joined and frozenset(("Fetch@shop/store/store.go", "KEY@jobs/report.py")) in joined
    assert len(names) == len(set(names.values()))


def test_focus_then_dwell(space):
    text, seen = space.focus("loadOrder")
    assert text.startswith('focus "loadOrder" · 1 match: loadOrder') and "[focus]" in text
    first = {r.id for r in seen.collect()}
    assert "loadOrder@web/orders.ts" in first
    more = {r.id for r in space.dwell()[1].collect()}
    assert not more & first
    route = {r.id for r in space.focus("/orders/{id}")[1].collect()}
    assert {"anchor:GET /orders/{*}", "loadOrder@web/orders.ts"} <= route
    assert "similar: loadOrder" in space.focus("loading ordering thing")[0]
    only = space.focus("loadOrder", path="web", language="typescript")[1]
    assert {r.lang for r in only.collect()} == {"TypeScript"}


@pytest.mark.parametrize("budget", [256, 300, 1000])
def test_texts_fit(space, budget):
    for text in (space.focus("send", budget, fresh=True)[0], space.sketch(budget)[0], space.impact(["jobs/mail.py"], budget=budget)[0]):
        assert -(-len(text) // 4) <= budget


def test_impact(space):
    text, files, nodes = space.impact(["web/client.ts"], now=F.lit("2024-01-10").cast("timestamp"))
    got = {r.file: r for r in files.collect()}
    assert "import dependency" in got["web/orders.ts"].reasons and got["lib/routes.rb"].reasons[0] == "co-change history"
    assert "web/client.ts" not in got and "via" in text
    assert {r.file for r in nodes.collect()} <= set(got) | {"shop/server.go", "deploy/app.yaml"} | {r.file for r in space.anchors().collect()}


def test_anchors_rules_status(space):
    assert {r.id: r.sites for r in space.anchors().collect()}["GET /orders/{*}"] == 2
    assert [r.id for r in space.discovered().collect()] == ["implicit:python:bare:every:0"]
    assert {r.status: r.files for r in space.status().collect()} == {"ok": len(CORPUS)}


def test_discovered_rules_can_be_adopted(spark, space):
    rules = tuple((r.id, (r.lang,), r.patterns[1], r.methods, "", "") for r in space.discovered().collect())
    wider = Workspace(space.source, rules=rules)
    assert {"EVERY /cron/a", "EVERY /reports/daily"} <= {r.id for r in wider.anchors().collect()}


def test_config():
    c = applied(Config(), '{"sync": {"budget": 1, "steerThreshold": 99, "mode": "odd", "enabled": false}, "tools": {"defaultBudget": 300.5, "grepMode": "off"}}')
    assert (c.sync_budget, c.steer_threshold, c.sync_mode, c.default_budget, c.search_mode) == (128, 8.0, "enabled", 301, "off")
    assert applied(Config(), '{"sync": {"enabled": false}}').sync_mode == "disabled"
    assert applied(Config(), "{broken") == applied(Config(), "[1]") == Config()


def test_git_texts(spark):
    out = spark.createDataFrame([(" M a/x.ts\x00?? a/y.ts\x00 M b/z.ts\x00",)], "text string")
    assert [(r.code, r.file, r.odd) for r in git.status(out, "a/").collect()] == [(" M", "x.ts", False), ("??", "y.ts", False), (" M", None, True)]
    lines = ["h1\x001700000000", "1\t2\ta.ts", "-\t-\tb.png", "", "h2\x001700000100", "3\t0\ta.ts"]
    got = git.log(spark.createDataFrame(list(enumerate(lines)), "n long, line string")).collect()
    assert [(r.commit, r.file) for r in got] == [("h1", "a.ts"), ("h1", "b.png"), ("h2", "a.ts")]


def test_same_stat(spark):
    x = spark.createDataFrame([(1, 1.0, 1, 1.0 + 1e-9), (1, 1.0, 2, 1.0), (1, 1.0, 1, 1.1)], "a long, b double, c long, d double")
    assert [r[0] for r in x.select(same_stat(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [True, False, False]
