"""Sync: compares a workspace with its stored baseline and says whether the difference matters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import is_test_scope, sync_scope
from emberline.operators import drift, provenance
from emberline.operators.ranking import global_rank
from emberline.sources import extract
from emberline.sources.files import version
from emberline.sources.lineage import cut
from emberline.workspace import Workspace

LEAST_DETAIL = 128


@dataclass
class Baseline:
    """anchors: id, file, implicit. files: file, sha, semantics. heat: key, m, t."""

    version: str
    anchors: DataFrame
    files: DataFrame
    heat: DataFrame
    armed: bool = True
    pushed: frozenset = field(default_factory=frozenset)


@dataclass
class Outcome:
    """kind: established, unchanged, rebased, absorbed, quiet or red. For the last, text and delivery."""

    kind: str
    baseline: Baseline
    text: str = ""
    delivery: str = "steer"
    surprise: float = 0.0


def facts(space: Workspace) -> DataFrame:
    """file, kind, value of everything that a file's meaning is made of; no line numbers."""
    row = lambda df, kind, *cols: df.select("file", F.lit(kind).alias("kind"), F.concat_ws("|", *cols).alias("value"))
    s = space.source
    parts = [row(extract.symbols(s), "symbol", "name", "kind", "sig", "lang"), row(extract.imports(s), "import", "spec"), row(extract.calls(s), "call", "callee"), row(extract.literals(s), "literal", "text")]
    out = parts[0]
    for x in parts[1:] + [row(space.graph.hubs, "anchor", "id", "kind", F.col("implicit").cast("string"))]:
        out = out.unionByName(x)
    return out.unionByName(s.select("file", F.lit("file").alias("kind"), F.lit("").alias("value")))


def snapshot(space: Workspace, heat: DataFrame | None = None, armed: bool = True, pushed: frozenset = frozenset()) -> Baseline:
    shas = space.source.select("file", F.sha1("text").alias("sha"))
    files = cut(shas.join(drift.fingerprint(facts(space)).withColumnRenamed("file", "f_file"), F.col("file") == F.col("f_file")).select("file", "sha", "semantics"), "baseline-files")
    none = space.spark.createDataFrame([], "key string, m double, t timestamp")
    return Baseline(version(shas).first()[0], cut(space.graph.hubs.select("id", "file", "implicit"), "baseline-anchors"), files, none if heat is None else heat, armed, pushed)


def sync(space: Workspace, baseline: Baseline | None, now, scopes: list[str] | None = None, checkout: bool = False, journal: DataFrame | None = None, owner: str = "", disclosed: list[str] = ()) -> Outcome:
    """One sync at the time `now` (a column). scopes: where the session has looked, None for everywhere. journal: mutations,
    for attribution to owners. disclosed: files whose warmth is known."""
    spark, config = space.spark, space.config
    if baseline is None:
        return Outcome("established", snapshot(space))
    current = snapshot(space, baseline.heat, baseline.armed, baseline.pushed)
    if current.version == baseline.version:
        return Outcome("unchanged", baseline)
    if checkout:
        return Outcome("rebased", current)
    changes = cut(drift.diff(baseline.files, current.files), "changes")
    if scopes is not None and config.sync_scope == "session":
        changes = cut(drift.attended(changes, spark.createDataFrame([(s,) for s in scopes], "scope string")), "attended")
        if not changes.head(1):
            return Outcome("absorbed", current)
    moved = changes.select("file")
    anchors = drift.anchor_changes(baseline.anchors.select("id", "file"), current.anchors.select("id", "file"), moved)
    if scopes is not None and config.sync_scope == "session":
        anchors = anchors.where(sync_scope(F.col("file")).isin(*scopes))
    anchors = cut(anchors, "anchor-changes")
    implicit = current.anchors.where("implicit").select(F.col("id").alias("i_id"))
    newly_implicit = anchors.where("change = 'added'").join(implicit, F.col("id") == F.col("i_id"), "left_semi")
    semantic = [r["file"] for r in changes.where("status in ('semantic', 'added')").orderBy("file").collect()]  # a turn's edits
    deleted = changes.where("status = 'deleted'").select("file")

    kind = "unattributed"
    if journal is not None:
        b, c = baseline.files.select(F.col("file").alias("bf"), F.col("sha").alias("before_sha")), current.files.select(F.col("file").alias("cf"), F.col("sha").alias("after_sha"))
        asked = moved.join(b, F.col("file") == F.col("bf"), "left").join(c, F.col("file") == F.col("cf"), "left").select("file", "before_sha", "after_sha")
        kind = provenance.overall(provenance.kinds(provenance.transition_owners(journal, asked), owner)).first()["kind"]

    _, warm_files, warm_nodes = space.impact(semantic, now=now) if semantic else (None, spark.createDataFrame([], "file string, mass double, top string, reasons array<string>"), spark.createDataFrame([], "key string, file string, m double, r array<string>"))
    known = spark.createDataFrame([(f,) for f in {*semantic, *disclosed}], "file string")
    held = cut(drift.cooled(baseline.heat, now), "held")
    deltas = cut(drift.surprise(warm_nodes, held, known), "deltas")
    by_file = cut(drift.file_surprise(deltas), "surprise")
    v = drift.verdict(anchors, deleted, by_file, newly_implicit.count(), baseline.armed, False, config.steer_threshold).first()
    memory = drift.charge(held, deltas, v["red"]).withColumn("t", now.cast("timestamp"))
    after = replace(current, heat=cut(memory, "memory"), armed=v["armed"])
    if not v["red"]:
        return Outcome("quiet", after, surprise=v["s"])

    delivery = "next-prompt" if kind == "other-session" else "steer"
    said = semantic or [r["file"] for r in deleted.orderBy("file").limit(5).collect()]
    lines = ["Repository structure changed.", f"Changed: {', '.join(said[:4]) or 'route structure'}" + (f" (+{len(said) - 4} more)" if len(said) > 4 else "")]
    if journal is not None:
        lines.append(f"Origin: {kind}.")
    listed = lambda change: [r["id"] for r in anchors.where((F.col("change") == change) & F.col("evidenced")).orderBy("id").limit(6).collect()]
    added = listed("added")
    lines += [f"Route added: {x}" for x in added] + [f"Route removed: {x}" for x in listed("removed")]
    order = global_rank(by_file.select((-F.round("surprise", 9)).alias("down"), is_test_scope(F.col("file")).alias("test"), "file"), "down", "test", "file").where("rank <= 8")
    warm = order.join(warm_files.select(F.col("file").alias("w_file"), "reasons"), F.col("file") == F.col("w_file"), "left").orderBy("rank").collect()
    if warm:
        lines += ["Newly relevant files:", *(f"  {r['file']} — {', '.join(r['reasons'] or ['graph path'])}" for r in warm)]
    target = next((x.split(" ", 1)[-1] for x in added), None) or (semantic or [r["file"] for r in warm] or [None])[0]
    action = "Notice: review this concurrent update on the next prompt if it affects the task." if delivery == "next-prompt" else "Steer: account for this update before continuing."
    left = config.sync_budget - -(-len("\n".join([*lines, action])) // 4)
    if config.push_focus and target in semantic and target not in baseline.pushed and left >= LEAST_DETAIL:
        lines += space.focus(target, left)[0].split("\n")
        after = replace(after, pushed=baseline.pushed | {target})
    elif target or not config.push_focus:
        lines.append(f"Next: focus {json.dumps(target)} to see what it now connects to." if target else "Next: sketch for the updated silhouette.")
    lines.append(action)
    while len(lines) > 3 and -(-len("\n".join(lines)) // 4) > config.sync_budget:
        del lines[-2]
    return Outcome("red", after, "\n".join(lines), delivery, v["s"])
