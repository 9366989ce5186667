import pytest
from emberline.config import Config
from emberline.plans.corpus import CORPUS
from emberline.sources import cache
from emberline.sync import sync
from emberline.workspace import Workspace
from pyspark.sql import functions as F

def at():
    return F.lit("2024-01-10").cast("timestamp")


def space(spark, **edits):
    rows = {**CORPUS, **{k.replace("__", "/").replace("_", "."): v for k, v in edits.items()}}
    return Workspace(spark.createDataFrame([(f, t) for f, t in rows.items() if t is not None], "file string, text string"), config=Config(steer_threshold=0.02))


@pytest.fixture(scope="module")
def base(spark):
    out = sync(space(spark), None, at())
    assert out.kind == "established"
    return out.baseline


def test_nothing_changed(spark, base):
    assert sync(space(spark), base, at()).kind == "unchanged"


def test_checkout_and_attention(spark, base):
    edited = space(spark, jobs__mail_py="def send(path):\n    pass\n")
    assert sync(edited, base, at(), checkout=True).kind == "rebased"
    assert sync(edited, base, at(), scopes=["web"]).kind == "absorbed"


def test_format_only_is_quiet(spark, base):
    same = space(spark, jobs__mail_py=CORPUS["jobs/mail.py"] + "\n\n")
    out = sync(same, base, at())
    assert out.kind == "quiet" and out.surprise == 0


def test_deletion_and_new_route_are_red(spark, base):
    out = sync(space(spark, lib__routes_rb=CORPUS["lib/routes.rb"] + 'get "/fresh", to: z\n'), base, at())
    assert out.kind == "red" and "Route added: GET /fresh" in out.text and out.text.endswith("before continuing.")
    gone = sync(space(spark, jobs__cron_py=None), base, at())
    assert gone.kind == "red" and "Changed: jobs/cron.py" in gone.text
    assert -(-len(out.text) // 4) <= 512


def test_warmth_fires_once(spark, base):
    edit = "def send(path, now):\n    every('/reports/daily', send)\n    every('/reports/hourly', send)\n    queue.push('mail')\n"
    first = sync(space(spark, jobs__mail_py=edit), base, at())
    assert first.kind == "red" and "jobs/report.py" in first.text and first.surprise > 0.02
    back = sync(space(spark), first.baseline, at())
    assert back.kind == "quiet" and back.surprise < first.surprise / 10


def test_other_owners_wait_for_the_next_prompt(spark, base):
    text = CORPUS["lib/routes.rb"] + 'get "/fresh", to: z\n'
    sha = lambda t: spark.createDataFrame([(t,)], "t string").select(F.sha1("t")).first()[0]
    rows = [("lib/routes.rb", sha(CORPUS["lib/routes.rb"]), sha(text), "you", "2024-01-09 00:00:00", 1, "c")]
    journal = spark.createDataFrame(rows, "file string, before_sha string, after_sha string, owner string, at string, commit_order int, tool_call_id string")
    out = sync(space(spark, lib__routes_rb=text), base, at(), journal=journal, owner="me")
    assert out.delivery == "next-prompt" and "Origin: other-session." in out.text


def test_cache(spark, tmp_path):
    path = str(tmp_path / "c")
    assert cache.load(spark, path, "k") is None
    cache.save(spark.range(3), path, "k")
    assert cache.load(spark, path, "k").count() == 3 and cache.load(spark, path, "other") is None
    (tmp_path / "f.jsonl").write_text('{"file": "a", "n": 1}\n{"file": "b", "n"\n{"file": "c", "n": 3}\n')
    assert [r.file for r in cache.read_facts(spark, str(tmp_path / "f.jsonl"), "file string, n int").collect()] == ["a", "c"]
    cache.spill(spark.createDataFrame([(2, "y"), (1, "x")], "rank int, line string"), str(tmp_path / "s"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "s")).collect()) == ["x", "y"]
