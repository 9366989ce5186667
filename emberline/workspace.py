"""The engine's operations over one set of files: sketch, focus, dwell, impact, anchors, rules, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.config import Config
from emberline.functions import fixed
from emberline.functions.kernel import choose_order
from emberline.operators import cochange, discovery, heat, impact, reveal, seeds
from emberline.operators.assembly import Graph, assemble
from emberline.operators.ranking import global_rank
from emberline.operators.sketch import sketch
from emberline.sources import extract
from emberline.sources.files import coverage
from emberline.sources.lineage import cut

FOCUS_T, MOST_T, LEAST_FACTOR, IMPACT_T, ORDER = 2.0, 64.0, 1.2, 4.0, 80


class Workspace:
    def __init__(self, files: DataFrame, commits: DataFrame | None = None, rules: tuple = (), config: Config | None = None):
        """files: file, text. commits: commit, ts, file. rules: further route rules, as extraction takes them."""
        self.source, self.commits, self.rules, self.config = files, commits, rules, config or Config()
        self.graph: Graph = assemble(files, rules)
        self.spark = files.sparkSession
        self.t = FOCUS_T
        self.seeds: DataFrame | None = None
        self.vectors: heat.Vectors | None = None
        self.disclosed = self.spark.createDataFrame([], "i long")
        self.scope: dict = {}
        self.asked: tuple = ()

    def _field(self, t: float) -> DataFrame:
        if self.vectors is None:
            self.vectors = heat.Vectors(self.graph.adj, self.seeds.select("i", F.lit(1.0).alias("v")))
        return self.vectors.field(t, max(ORDER, choose_order(t)))

    def _shown(self, header: str, budget: int | None, repeat: bool) -> tuple[str, DataFrame]:
        from emberline.functions.text import in_scope

        g = self.graph
        include = g.nodes.where(in_scope(F.col("file"), F.col("lang"), F.col("kind"), **self.scope)).select("i") if self.scope else None
        lit = cut(reveal.lit_nodes(g.nodes, cut(self._field(self.t), "field"), g.edges, self.seeds, self.disclosed, include, repeat_nucleus=repeat), "lit")
        text, shown = render(header, reveal.lines(lit), lit.count(), clamp(budget, self.config.default_budget))
        seen = lit.join(shown, lit["rank"] == shown["s_rank"], "left_semi").where("role <> 'glow'")
        self.disclosed = cut(self.disclosed.unionByName(seen.select("i")).distinct(), "disclosed")
        return text, seen

    def focus(self, query: str, budget: int | None = None, fresh: bool = False, **scope) -> tuple[str, DataFrame]:
        """Text within the budget and the nodes it shows. scope: path, language, of_kind."""
        found = cut(seeds.resolve(self.graph.nodes, self.graph.keys, self.graph.occ, query, **scope), "seeds")
        names = [r["name"] for r in found.join(self.graph.nodes.select(F.col("i").alias("n_i"), "name"), F.col("i") == F.col("n_i")).orderBy(F.desc("score"), "i").limit(4).collect()]
        if not names:
            near = [f"{r['name']} ({r['file']})" for r in seeds.suggestions(self.graph.nodes, query, **scope).collect()]
            return f'focus "{query}" · no graph match' + (f"\nsimilar: {', '.join(near)}" if near else ""), self.graph.nodes.limit(0)
        key = (tuple(sorted(r["i"] for r in found.collect())), tuple(sorted(scope.items())))  # at most MAX_SEEDS rows
        if fresh or key != self.asked:
            self.t, self.vectors, self.asked, self.scope = FOCUS_T, None, key, scope
            self.disclosed = self.spark.createDataFrame([], "i long")
        self.seeds = found.select("i")
        return self._shown(f'focus "{query}" · {len(key[0])} match{"es" * (len(key[0]) != 1)}: {", ".join(names)}', budget, True)

    def dwell(self, factor: float = 2.0, budget: int | None = None) -> tuple[str, DataFrame]:
        """What a wider field shows beyond what was shown."""
        if self.seeds is None:
            return "dwell: no focus yet", self.graph.nodes.limit(0)
        before, self.t = self.t, min(MOST_T, self.t * max(LEAST_FACTOR, factor))
        return self._shown(f"dwell · context widened {round(self.t / before, 1):g}× · new results", budget, False)

    def sketch(self, budget: int | None = None) -> tuple[str, DataFrame]:
        groups = cut(sketch(self.graph.nodes, self.graph.edges), "groups")
        return self._groups(f"sketch · {self.graph.files.count()} files · {self.graph.nodes.count()} symbols", groups, budget), groups

    def _groups(self, header: str, groups: DataFrame, budget: int | None) -> str:
        ranked = global_rank(groups.withColumn("down", -F.round("mass", 9)), "down", "label")
        items = ranked.select("rank", F.concat_ws(" · ", "label", "detail").alias("line"))
        return render(header, items, groups.count(), clamp(budget, self.config.default_budget))[0]

    def impact(self, files: list[str] = (), symbols: list[str] = (), budget: int | None = None, now=None) -> tuple[str, DataFrame, DataFrame]:
        """Text, warmed files (file, mass, top, reasons) and warmed nodes (key, file, m, r)."""
        g = self.graph
        start = g.nodes.where((F.col("kind") == "file") & F.col("file").isin(*files)).select("i")
        for s in symbols:
            start = start.unionByName(seeds.resolve(g.nodes, g.keys, g.occ, s).select("i"))
        start = cut(start.distinct(), "impact-seeds")
        heat_in = start.select("i", F.lit(1.0).alias("v"))
        partners = self.spark.createDataFrame([], "partner string, w double")
        if self.commits is not None:
            known = self.commits.join(g.files.select(F.col("file").alias("k_file")), F.col("file") == F.col("k_file"), "left_semi")
            at = F.current_timestamp() if now is None else now
            history = cochange.both_ways(cochange.kept(cochange.pairs(cochange.last_commits(known)), at))
            changed = g.nodes.join(start.toDF("s_i"), F.col("i") == F.col("s_i"), "left_semi").select("file")
            partners = cut(cochange.partner_seeds(history, changed, at), "partners")
            at_file = g.nodes.where("kind = 'file'").select(F.col("file").alias("p_file"), "i")
            heat_in = heat_in.unionByName(partners.join(at_file, partners["partner"] == at_file["p_file"]).select("i", F.col("w").alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))
        field = heat.heat_field(g.adj, heat_in, IMPACT_T)
        warm = cut(impact.masses(g.nodes, field, start), "warm")
        direct = impact.direct_reasons(g.edges, g.nodes, start)
        paths = impact.path_reasons(g.edges, start.select("i", F.col("i").alias("pos")))
        first = direct.groupBy("node").agg(F.min_by("reason", "pos").alias("reason"))
        by_node = paths.join(first.toDF("d_node", "reason"), F.col("node") == F.col("d_node"), "full_outer").select(F.coalesce("node", "d_node").alias("node"), F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.col("reasons")).alias("r"))
        place = g.nodes.select(F.col("i").alias("n_i"), F.col("file").alias("n_file"))
        far = paths.where(F.size("reasons") > 0).join(place, F.col("node") == F.col("n_i")).groupBy("n_file").agg(F.slice(F.min_by("reasons", F.struct("level", "node")), 1, 3).alias("x"))
        warmed_files = cut(impact.reviewed(impact.file_mass(warm), direct, far, partners), "warm-files")
        ledger = impact.warmed(warm, by_node.select("node", F.coalesce("r", F.array().cast("array<string>")).alias("r")))
        detail = F.concat(F.lit("via "), F.array_join("reasons", ", "), F.when(F.col("top") != "", F.concat(F.lit(" · top: "), "top")).otherwise(""))
        routes = warm.where("place = 'anchor'").select(F.concat(F.lit("⚑ "), "name").alias("label"), F.col("v").alias("mass"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("detail"))
        groups = cut(routes.unionByName(warmed_files.select(F.col("file").alias("label"), "mass", detail.alias("detail"))), "impact-groups")
        return self._groups(f"impact · changed: {', '.join([*files, *symbols][:5])} · likely review order", groups, budget), warmed_files, ledger

    def anchors(self) -> DataFrame:
        return self.graph.hubs.select("id", "kind", "label", "file", "line", "sites", "implicit").orderBy("id")

    def discovered(self) -> DataFrame:
        """Rules that the files' own calls suggest and no rule covers."""
        lines = extract.lines(self.source).select("file", "lang", "line")
        known = self.spark.createDataFrame([(lang, r[3], r[2]) for r in extract.ANCHOR_RULES + self.rules for lang in r[1]], "lang string, methods string, pattern string")
        return discovery.promoted(discovery.covered(discovery.histogram(discovery.call_arguments(lines)), known))

    def status(self) -> DataFrame:
        return coverage(self.source).groupBy("status").agg(F.count("*").alias("files"))


def clamp(asked: int | None, default: int) -> int:
    return max(256, min(16000, default if asked is None else asked))


def render(header: str, items: DataFrame, total: int, budget: int) -> tuple[str, DataFrame]:
    """The longest text within the budget, and the ranks (s_rank) it shows. Fewer lines than the budget has tokens fit, so
    what reaches the driver is bounded by it."""
    footer = "\n…  more results collapsed or outside budget"
    few = items.orderBy("rank").limit(4 * budget)
    shown = reveal.fitting(few, len(header) + 1, total, len(footer), budget).where("shown").select(F.col("rank").alias("s_rank"), "line")
    rows = sorted(shown.collect(), key=lambda r: r["s_rank"])
    left = total - len(rows)
    text = "\n".join([header, *(r["line"] for r in rows)]) + (footer.replace("…  more", f"… {left} more") if left > 0 else "")
    return text, shown
