"""Queries over a small invented corpus of several languages; what they must return is written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.operators import discovery, graph
from emberline.plans.bindings import LITERALS_SQL, class_sql, page_literals
from emberline.plans.registry import query, values
from emberline.sources import extract

CORPUS = {
    "shop/server.go": 'package shop\n\nimport "shop/store"\n\nfunc (s *Shop) Serve(port int) {\n\tmux.HandleFunc("GET /orders/{id}", s.order)\n\trouter.Get("/carts/:cart", s.cart)\n\tstore.Fetch(port)\n}\n\ntype Shop struct {\n',
    "shop/store/store.go": 'package store\n\nfunc Fetch(id int) string {\n\treturn os.Getenv("SHOP_DB_URL")\n}\n',
    "web/orders.ts": "import { client } from './client';\nexport class Orders extends Base {\n}\nexport function loadOrder(id: string) {\n  return client.get(`/orders/${id}`);\n}\nconst LIMIT = 10;\n",
    "web/client.ts": "export const client = makeClient('https://shop.example/api');\nexport function ping() { return fetch('/health'); }\n",
    "web/orders.test.ts": "import { loadOrder } from './orders';\nloadOrder('x1');\n",
    "web/carts.controller.ts": "@Controller('carts')\nexport class CartsController implements Closeable, Base {\n  @Get(':cart')\n  @Post('bulk/add')\n}\n",
    "jobs/report.py": "import jobs.mail\nfrom jobs.mail import send\n\nKEY = os.environ['SHOP_DB_URL']\n\nclass Report(Base):\n    def build(self):\n        send('/reports/weekly')\n\n@app.route('/reports/<name>')\ndef show(name):\n    return Report()\n",
    "jobs/mail.py": "def send(path):\n    every('/reports/daily', send)\n    every('/reports/hourly', send)\n    queue.push('mail')\n",
    "jobs/cron.py": "def start():\n    every('/cron/a', start)\n    every('/cron/b', start)\n    path(\"admin/\", view)\n",
    "deploy/app.yaml": "env: SHOP_DB_URL\npath: /orders/{id}\nname: \"shop\"\n",
    "site/app/users/[id]/route.ts": "export async function GET() {}\nexport const DELETE = 1;\n",
    "site/pages/api/ping.post.ts": "export default 1;\n",
    "lib/routes.rb": 'get "/login", to: x\nmatch \'/about\', to: y\n',
    "lib/core.rs": "use crate::util;\nfn run() {\n    app.route(\"/core\", get(run));\n}\n",
    "src/util.rs": "struct Util {\n",
}


#: What spans lines, and what is no code: comments, strings, templates.
SPREAD = {
    "web/panel.ts": "import {\n  first,\n  use,\n} from './use-state';\n/* import x from './gone';\n   send('/api/gone'); */\nexport class Panel extends View {\n  private open = false;\n  label?: string;\n  @Input() size: number;\n  constructor(private host: Host) {\n    super(host);\n  }\n  // close() was here\n  async load(\n    id: string,\n  ): Promise<void> {\n    await http.get(\n      `/panels/${id}`,\n      { wait: true },\n    );\n    note('draw(it) // not a comment', `${encode(id)} draw(it)`);\n  }\n}\nexport interface Host {\n  name: string;\n  attach(panel: Panel): void;\n}\nfunction later(cb) {\n  const inner = 1;\n}\n",
    "srv/Panels.java": "@RequestMapping(\n    \"/java\")\npublic class Panels {\n  private final Store store = new Store(1);\n  @GetMapping(\n      \"/list\") // \"/not\"\n  public List<String> all(int page) {\n    if (page > 0) { return store.fetch(page); }\n    return null;\n  }\n}\n",
    "srv/main.go": "package main\n\nimport (\n\t\"net/http\"\n\tpanels \"srv/panels\"\n)\n\n// mux.Get(\"/gone\", nil)\ntype Hub struct {\n\tstore *Store\n\tDial(port int) error\n}\n\nfunc run() {\n\tmux.Handle(\n\t\t\"/hub\",\n\t\tserve(`fake(1)`))\n\tnames := []string{\n\t\t\"alpha\"}\n}\n",
    "srv/lib.rs": "use crate::{\n    one, two,\n};\nstruct Hub<'a> {\n    name: &'a str,\n}\nimpl<'a> Hub<'a> {\n    pub fn open(&self) {\n        // shut(1)\n        start(\"stop(2)\");\n    }\n}\n",
    "srv/App.kt": "class App {\n    val size = 3\n    fun boot(n: Int) {\n        get(\"/boot\") {\n        }\n    }\n}\n",
    "jobs/run.py": "\"\"\"Calls nothing: idle(1)\n'unclosed\n\"\"\"\n# wake(2)\nfrom jobs.mail import (\n    send,\n)\n\nclient.post(\n    '/jobs/run',\n    data=pack('x # y'),\n)\n",
}


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CORPUS.items()), "file string, text string")


def spread(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPREAD.items()), "file string, text string")


SYMBOLS = [
    ("jobs/cron.py", "start", "function", 1), ("jobs/mail.py", "send", "function", 1), ("jobs/report.py", "KEY", "decl", 4), ("jobs/report.py", "Report", "class", 6),
    ("jobs/report.py", "Report.build", "method", 7), ("jobs/report.py", "show", "function", 11), ("lib/core.rs", "run", "function", 2), ("shop/server.go", "Shop", "class", 11),
    ("shop/server.go", "Shop.Serve", "method", 5), ("shop/store/store.go", "Fetch", "function", 3), ("site/app/users/[id]/route.ts", "DELETE", "function", 2), ("site/app/users/[id]/route.ts", "GET", "function", 1),
    ("src/util.rs", "Util", "class", 1), ("web/carts.controller.ts", "CartsController", "class", 2), ("web/client.ts", "client", "function", 1), ("web/client.ts", "ping", "function", 2),
    ("web/orders.ts", "LIMIT", "function", 7), ("web/orders.ts", "Orders", "class", 2), ("web/orders.ts", "loadOrder", "function", 4),
]


@query(values("file VARCHAR, name VARCHAR, kind VARCHAR, line INT", SYMBOLS))
def a9_symbols(spark, sf):
    return extract.symbols(corpus(spark)).select("file", "name", "kind", "line")


MEMBERS = [
    ("srv/App.kt", "App", "class", 1, "class App {"), ("srv/App.kt", "App.boot", "method", 3, "fun boot(n: Int) {"), ("srv/App.kt", "App.size", "field", 2, "val size = 3"),
    ("srv/Panels.java", "Panels", "class", 3, "public class Panels {"), ("srv/Panels.java", "Panels.all", "method", 7, "public List<String> all(int page) {"), ("srv/Panels.java", "Panels.store", "field", 4, "private final Store store = new Store(1)"),
    ("srv/lib.rs", "Hub", "class", 4, "struct Hub<'a> {"), ("srv/lib.rs", "Hub.name", "field", 5, "name: &'a str,"), ("srv/lib.rs", "Hub.open", "method", 8, "pub fn open(&self) {"),
    ("srv/main.go", "Hub", "class", 9, "type Hub struct {"), ("srv/main.go", "Hub.Dial", "method", 11, "Dial(port int) error"), ("srv/main.go", "Hub.store", "field", 10, "store *Store"), ("srv/main.go", "run", "function", 14, "func run() {"),
    ("web/panel.ts", "Host", "interface", 25, "export interface Host {"), ("web/panel.ts", "Host.attach", "method", 27, "attach(panel: Panel): void"), ("web/panel.ts", "Host.name", "field", 26, "name: string"),
    ("web/panel.ts", "Panel", "class", 7, "export class Panel extends View {"), ("web/panel.ts", "Panel.constructor", "method", 11, "constructor(private host: Host) {"), ("web/panel.ts", "Panel.label", "field", 9, "label?: string"),
    ("web/panel.ts", "Panel.load", "method", 15, "async load("), ("web/panel.ts", "Panel.open", "field", 8, "private open = false"), ("web/panel.ts", "Panel.size", "field", 10, "size: number"), ("web/panel.ts", "later", "function", 29, "function later(cb) {"),
]


@query(values("file VARCHAR, name VARCHAR, kind VARCHAR, line INT, sig VARCHAR", MEMBERS))
def a9_members(spark, sf):
    return extract.symbols(spread(spark)).select("file", "name", "kind", "line", "sig")


NAMED = [("func (s *Shop) Serve(x int)", "Go", "Shop.Serve", "method"), ("type X struct {", "Go", "X", "class"), ("export interface Y {", "TypeScript", "Y", "interface"), ("*ptr = 3", "C", "ptr", "decl"), ("defmodule A.B do", "Elixir", "A.B", "class"), ("", "Lua", "?", "decl")]


@query(values("sig VARCHAR, name VARCHAR, kind VARCHAR", [(s, n, k) for s, _, n, k in NAMED]))
def a10_signature_names(spark, sf):
    x = spark.createDataFrame([(s, g) for s, g, _, _ in NAMED], "sig string, lang string")
    return x.withColumn("d", extract.signature_name(F.col("sig"), F.col("lang"))).select("sig", "d.name", "d.kind")


IMPORTS = [("shop/server.go", "shop/store", 3), ("web/orders.ts", "./client", 1), ("web/orders.test.ts", "./orders", 1), ("jobs/report.py", "jobs.mail", 1), ("jobs/report.py", "jobs.mail", 2), ("lib/core.rs", "crate::util", 1)]


@query(values("file VARCHAR, spec VARCHAR, line INT", IMPORTS))
def a12_imports(spark, sf):
    return extract.imports(corpus(spark))


@query(values("file VARCHAR, spec VARCHAR, line INT", [("web/panel.ts", "./use-state", 1), ("srv/main.go", "net/http", 3), ("srv/main.go", "srv/panels", 3), ("srv/lib.rs", "crate", 1), ("jobs/run.py", "jobs.mail", 5)]))
def a12_spread_imports(spark, sf):
    return extract.imports(spread(spark))


CALLS = [
    ("shop/server.go", 6, "HandleFunc"), ("shop/server.go", 7, "Get"), ("shop/server.go", 8, "Fetch"), ("shop/store/store.go", 4, "Getenv"), ("web/orders.ts", 5, "get"), ("web/client.ts", 1, "makeClient"), ("web/client.ts", 2, "fetch"),
    ("web/orders.test.ts", 2, "loadOrder"), ("web/carts.controller.ts", 1, "Controller"), ("web/carts.controller.ts", 3, "Get"), ("web/carts.controller.ts", 4, "Post"), ("jobs/report.py", 8, "send"), ("jobs/report.py", 10, "route"),
    ("jobs/report.py", 12, "Report"), ("jobs/mail.py", 2, "every"), ("jobs/mail.py", 3, "every"), ("jobs/mail.py", 4, "push"), ("jobs/cron.py", 2, "every"), ("jobs/cron.py", 3, "every"), ("jobs/cron.py", 4, "path"), ("lib/core.rs", 3, "route"), ("lib/core.rs", 3, "get"),
]


@query(values("file VARCHAR, line INT, callee VARCHAR", CALLS))
def a13_calls(spark, sf):
    return extract.calls(corpus(spark))


SPREAD_CALLS = [
    ("web/panel.ts", 18, "get"), ("web/panel.ts", 22, "encode"), ("web/panel.ts", 22, "note"), ("srv/Panels.java", 1, "RequestMapping"),
    ("srv/Panels.java", 4, "Store"), ("srv/Panels.java", 5, "GetMapping"), ("srv/Panels.java", 8, "fetch"), ("srv/main.go", 15, "Handle"), ("srv/main.go", 17, "serve"), ("srv/lib.rs", 10, "start"),
    ("srv/App.kt", 4, "get"), ("jobs/run.py", 9, "post"), ("jobs/run.py", 11, "pack"),
]


@query(values("file VARCHAR, line INT, callee VARCHAR", SPREAD_CALLS))
def a13_code_only(spark, sf):
    """Calls in comments and strings aren't calls, those that a template puts in are; declarations aren't."""
    return extract.calls(spread(spark))


@query(values("file VARCHAR, line INT, text VARCHAR", [("deploy/app.yaml", 1, "SHOP_DB_URL"), ("deploy/app.yaml", 2, "/orders/{id}"), ("deploy/app.yaml", 3, "shop")]))
def a15_config_literals(spark, sf):
    return extract.literals(corpus(spark).where("file like '%.yaml'"))


ROUTES = [
    ("GET /orders/{*}", "shop/server.go", 6), ("GET /carts/{*}", "shop/server.go", 7), ("GET /orders/{*}", "web/orders.ts", 5), ("GET /health", "web/client.ts", 2), ("GET /carts/{*}", "web/carts.controller.ts", 3),
    ("POST /carts/bulk/add", "web/carts.controller.ts", 4), ("ANY /admin", "jobs/cron.py", 4), ("GET /login", "lib/routes.rb", 1), ("ANY /about", "lib/routes.rb", 2), ("ROUTE /core", "lib/core.rs", 3),
]


@query(values("id VARCHAR, file VARCHAR, line INT", ROUTES))
def a16_route_anchors(spark, sf):
    """Python's own decorator route has a placeholder that no path token allows, so it isn't one."""
    return extract.anchors(corpus(spark)).select("id", "file", "line")


@query(values("id VARCHAR, file VARCHAR, line INT", [("GET /panels/{*}", "web/panel.ts", 18), ("GET /java/list", "srv/Panels.java", 5), ("HANDLE /hub", "srv/main.go", 15), ("GET /boot", "srv/App.kt", 4), ("POST /jobs/run", "jobs/run.py", 9)]))
def a16_spread_anchors(spark, sf):
    return extract.anchors(spread(spark)).select("id", "file", "line")


@query(values("id VARCHAR, kind VARCHAR, file VARCHAR", [("GET /users/{*}", "route", "site/app/users/[id]/route.ts"), ("DELETE /users/{*}", "route", "site/app/users/[id]/route.ts"), ("POST /api/ping", "route", "site/pages/api/ping.post.ts")]))
def a17_file_routes(spark, sf):
    return extract.file_routes(corpus(spark)).select("id", "kind", "file")


@query(values("raw VARCHAR, ok BOOLEAN", [("/users/:id", True), (":id", True), ("{slug}", True), ("hello world", False), ("[x]", True), ("^/re$", False)]))
def b11_anchor_validation(spark, sf):
    x = spark.createDataFrame([("/users/:id",), (":id",), ("{slug}",), ("hello world",), ("[x]",), ("^/re$",)], "raw string")
    return x.select("raw", extract.is_route(F.col("raw")).alias("ok"))


RESOLVED = [("shop/server.go", "shop/store", "shop/store/store.go"), ("web/orders.ts", "./client", "web/client.ts"), ("web/orders.test.ts", "./orders", "web/orders.ts"), ("jobs/report.py", "jobs.mail", "jobs/mail.py"), ("lib/core.rs", "crate::util", "src/util.rs")]


@query(values("file VARCHAR, spec VARCHAR, target VARCHAR", RESOLVED))
def c2_resolve_imports(spark, sf):
    files = corpus(spark)
    return graph.resolve_imports(extract.imports(files), files.select("file"))


@query(values("id VARCHAR, kind VARCHAR, file VARCHAR", [("ANY /v1/routes", "route", "lib/routes.rb"), ("GET /users/{*}", "route", "site/app/users/[id]/route.ts"), ("DELETE /users/{*}", "route", "site/app/users/[id]/route.ts"), ("POST /api/ping", "route", "site/pages/api/ping.post.ts")]))
def i2_own_file_routes(spark, sf):
    """The built-in rules with one of the user's."""
    own = (("ruby-lib", r"^lib/(.+)\.rb$", "suffix", "/v1", "route"),)
    return extract.file_routes(corpus(spark), fixed.FILE_ROUTES + own).select("id", "kind", "file")


CLASSES = [(1, "Base", "class Base"), (2, "Orders", "export class Orders extends Base {"), (3, "Carts", "class Carts implements Closeable, Base {"), (4, "Closeable", "interface Closeable")]


@query(values('idx BIGINT, "to" BIGINT', [(2, 1), (3, 1), (3, 4)]))
def c5_inheritance(spark, sf):
    defs = spark.createDataFrame([(i, "a.ts", n) for i, n, _ in CLASSES], "idx long, file string, name string")
    return graph.inherited(spark.createDataFrame([(i, s) for i, _, s in CLASSES], "idx long, sig string"), defs)


def sigs(spark):
    lines = extract.lines(corpus(spark)).select("file", "lang", "line")
    return discovery.histogram(discovery.call_arguments(lines))


#: Calls made of pages: each quoted literal is an argument of one of a few callees; most of some callees' are paths.
ARGS_SQL = f"args AS (SELECT file, 'Python' AS lang, CASE line % 3 WHEN 0 THEN 'recv' WHEN 1 THEN 'bare' ELSE 'dec' END AS shape, CASE WHEN text LIKE '/%' AND line % 5 > 0 THEN 'visit' ELSE 'other' || node % 3 END AS callee, (node % 2)::INT AS arg, text, {class_sql('text')} AS cls FROM lits)"
HISTOGRAM_SQL = f"{LITERALS_SQL}, {ARGS_SQL}, h AS (SELECT lang, shape, callee, arg, count(*) AS n, count(*) FILTER (cls = 'path') AS path_n, count(DISTINCT file) AS files FROM args GROUP BY ALL)"


def page_sigs(spark, sf):
    x = page_literals(spark, sf)
    shape = F.when(F.col("line") % 3 == 0, "recv").when(F.col("line") % 3 == 1, "bare").otherwise("dec")
    callee = F.when(F.col("text").startswith("/") & (F.col("line") % 5 > 0), "visit").otherwise(F.concat(F.lit("other"), (F.col("node") % 3).cast("string")))
    return discovery.histogram(x.select("file", F.lit("Python").alias("lang"), shape.alias("shape"), callee.alias("callee"), (F.col("node") % 2).cast("int").alias("arg"), "text"))


@query(f"WITH {HISTOGRAM_SQL} SELECT * FROM h")
def d4_signature_histogram(spark, sf):
    return page_sigs(spark, sf).select("lang", "shape", "callee", "arg", "n", "path_n", "files")


@query(f"""WITH {HISTOGRAM_SQL}, p AS (SELECT *, (path_n + 0.5) / (n + 1.0) AS p FROM h)
SELECT 'implicit:python:' || shape || ':' || callee || ':' || arg AS id, '^(?i:' || callee || ')$' AS methods, CASE shape WHEN 'recv' THEN '$R.$M(' WHEN 'bare' THEN '$M(' ELSE '@$M(' END || CASE arg WHEN 0 THEN '$P' ELSE '$X0, $P' END || ', $$$H)' AS pattern, n, files, round(p, 6)::DOUBLE AS posterior
FROM p WHERE n >= {fixed.MIN_SITES} AND files >= {fixed.MIN_SIG_FILES} AND p >= {fixed.MIN_POSTERIOR}""")
def d5_promoted_rules(spark, sf):
    return discovery.promoted(page_sigs(spark, sf)).select("id", "methods", F.element_at("patterns", 2).alias("pattern"), "n", "files", F.round("posterior", 6).alias("posterior"))


@query(values("lang VARCHAR, callee VARCHAR", [("Python", "every"), ("Python", "push"), ("Python", "send"), ("Python", "route")]))
def c16_rule_coverage(spark, sf):
    # a decorator on a receiver isn't among the compatible shapes, so route stays
    rules = spark.createDataFrame([(lang, r[3], r[2]) for r in extract.ANCHOR_RULES for lang in r[1]], "lang string, methods string, pattern string")
    return discovery.covered(sigs(spark).where("lang = 'Python'"), rules).select("lang", "callee")


@query(values("pattern VARCHAR, methods VARCHAR, known BOOLEAN", [("$M($P)", "^visit$", True), (None, "^x$", False)]))
def a23_rules_file(spark, sf):
    from emberline.sources.rules import parse_rules

    docs = spark.createDataFrame([('{"rules": [{"id": "v", "pattern": "$M($P)", "methods": "^visit$", "langs": ["Go"]}, {"id": "w", "methods": "^x$", "langs": ["Go"]}]}',), ("{broken",)], "doc string")
    return parse_rules(docs, keep_invalid=True).select("pattern", "methods", F.col("valid").alias("known"))
