"""Queries over listings, literals and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import fixed, text
from emberline.plans.bindings import FILES_SQL, LITERALS_SQL, PATH_SQL, class_sql, document_files, norm_sql, page_literals, table
from emberline.plans.registry import query, values
from emberline.sources.files import listed

q = lambda xs: ", ".join(f"'{x}'" for x in xs)
EXT = "lower(string_split(file, '.')[-1])"
JUNK = f"(len(list_intersect(string_split(file, '/'), [{q(fixed.IGNORED_DIRS)}])) > 0 OR lower(string_split(file, '/')[-1]) IN ({q(fixed.LOCK_FILES)}) OR lower(string_split(file, '/')[-1]) LIKE '%.lock')"
ROUTES = "|".join(r[1] for r in fixed.FILE_ROUTES)
KNOWN = f"(({EXT} NOT IN ({q(fixed.BINARY_EXTENSIONS)}) AND {EXT} IN ({q((*fixed.LANGUAGES, *fixed.CONFIG_EXTENSIONS))})) OR regexp_matches(file, '{ROUTES}'))"
LANG = "CASE " + " ".join(f"WHEN {EXT} = '{k}' THEN '{v}'" for k, v in fixed.LANGUAGES.items()) + " ELSE 'config' END"
GENERATED = f"(regexp_matches(file, '{fixed.GENERATED_NAME}') OR (length(text) >= {fixed.LONG_LINE} AND len(list_filter(string_split(text, chr(10)), lambda l: length(l) >= {fixed.LONG_LINE})) > 0))"
TEST = f"regexp_matches(file, '{fixed.TEST_FILE}')"
SCOPE = f"({TEST} OR regexp_matches(file, '{fixed.TEST_SCOPE}'))"
COUNTED = "SELECT {0}, count(*) AS n FROM f GROUP BY ALL"


@query(f"WITH f AS ({FILES_SQL}) SELECT file FROM f WHERE {KNOWN} AND NOT {JUNK} ORDER BY file LIMIT 60")
def a1_list_files(spark, sf):
    """A listing has a limit of its own, the first MAX_FILES files in order; here 60."""
    return listed(document_files(spark, sf), cap=60).select("file")


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id, {JUNK} AS junk FROM f")
def a2_junk_files(spark, sf):
    return document_files(spark, sf).select("doc_id", text.is_junk(F.col("file")).alias("junk"))


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id, {KNOWN} AS supported, {LANG} AS lang, {EXT} IN ({q(fixed.CONFIG_EXTENSIONS)}) AS config FROM f")
def a3_supported_files(spark, sf):
    c = F.col("file")
    return document_files(spark, sf).select("doc_id", text.is_supported(c).alias("supported"), text.language_of(c).alias("lang"), text.is_config(c).alias("config"))


BOUNDARIES = [("app",), ("app/sub",), ("lib/x",)]
NESTED = [("app/a.ts", "app"), ("app/sub/b.ts", "app/sub"), ("lib/x/c.py", "lib/x"), ("lib/y.py", None), ("top.go", None)]


@query(values("file VARCHAR, owner VARCHAR, listed BOOLEAN", [("app/a.ts", "app", True), ("app/sub/b.ts", "app/sub", False), ("lib/x/c.py", "lib/x", False), ("lib/y.py", None, True), ("top.go", None, True)]))
def a4_nested_boundaries(spark, sf):
    """A nested repository's files are listed only if its root is enrolled (here: app)."""
    from emberline.sources.files import nested_owner

    files = spark.createDataFrame([(f,) for f, _ in NESTED], "file string")
    roots = spark.createDataFrame([(b, b == "app") for (b,) in BOUNDARIES], "root string, enrolled boolean")
    return nested_owner(files, roots)


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id, sha1(text) AS sha FROM f")
def a6_content_hash(spark, sf):
    return document_files(spark, sf).select("doc_id", F.sha1("text").alias("sha"))


STATUS = f"CASE WHEN strlen(text) > 16384 THEN 'oversized' WHEN {GENERATED} THEN 'generated' ELSE 'ok' END"


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id, {STATUS} AS status FROM f")
def a7_size_cap(spark, sf):
    from emberline.sources.files import coverage

    return coverage(document_files(spark, sf), max_bytes=16384).select("doc_id", "status")


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id, {GENERATED} AS generated FROM f")
def a8_generated_sources(spark, sf):
    return document_files(spark, sf).select("doc_id", text.is_generated(F.col("file"), F.col("text")).alias("generated"))


@query(f"WITH {LITERALS_SQL} SELECT node, line::INT AS line, text FROM lits")
def a14_string_literals(spark, sf):
    return page_literals(spark, sf).select("node", "line", "text")


@query(f"WITH {LITERALS_SQL}, x AS (SELECT *, {class_sql('text')} AS cls FROM lits) SELECT cls, count(*) AS n FROM x GROUP BY cls")
def b1_classify_literal(spark, sf):
    return page_literals(spark, sf).groupBy(text.literal_class(F.col("text")).alias("cls")).agg(F.count("*").alias("n"))


@query(f"WITH {LITERALS_SQL}, x AS (SELECT *, {class_sql('text')} AS cls FROM lits) SELECT node, line::INT AS line, text, {norm_sql('text', 'cls')} AS key FROM x WHERE cls IS NOT NULL")
def b2_normalize_literal(spark, sf):
    x = page_literals(spark, sf).withColumn("cls", text.literal_class(F.col("text"))).where("cls is not null")
    return x.select("node", "line", "text", text.normal_literal(F.col("text"), F.col("cls")).alias("key"))


@query(f"WITH {LITERALS_SQL} SELECT text, count(*) AS n FROM lits WHERE regexp_matches(text, '{fixed.PATH_TOKEN}') GROUP BY text")
def b3_path_tokens(spark, sf):
    return page_literals(spark, sf).where(F.col("text").rlike(fixed.PATH_TOKEN)).groupBy("text").agg(F.count("*").alias("n"))


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id, {TEST} AS is_test FROM f")
def b4_test_files(spark, sf):
    return document_files(spark, sf).select("doc_id", text.is_test_file(F.col("file")).alias("is_test"))


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id, {SCOPE} AS is_test FROM f")
def b5_test_scope(spark, sf):
    return document_files(spark, sf).select("doc_id", text.is_test_scope(F.col("file")).alias("is_test"))


METHODS = [("GetMapping", "GET"), ("RequestMapping", "REQUEST"), ("path", "ANY"), ("fetch", "GET"), ("post", "POST"), ("resources", "ANY"), ("redirect_to", "GET"), ("respondRedirect", "GET"), ("re_path", "ANY")]


@query(values("method VARCHAR, matches BOOLEAN", [("GET", True), ("Post", True), ("getx", False), ("put", True), ("route", False)]))
def b6_method_pattern(spark, sf):
    x = spark.createDataFrame([("GET",), ("Post",), ("getx",), ("put",), ("route",)], "method string")
    return x.select("method", F.col("method").rlike("^(?i:get|post|put)$").alias("matches"))


QUOTED = [("'/users'", "/users"), ('f"/items/{id}"', "/items/{id}"), ("`/a`", "/a"), ("  plain ", "plain"), ('rb"x"', "x"), ("\"open'", "\"open'")]


@query(values("raw VARCHAR, bare VARCHAR", QUOTED))
def b7_unquote(spark, sf):
    return spark.createDataFrame([(r,) for r, _ in QUOTED], "raw string").select("raw", text.unquote(F.col("raw")).alias("bare"))


@query(values("method VARCHAR, verb VARCHAR", METHODS))
def b8_verbs(spark, sf):
    return spark.createDataFrame([(m,) for m, _ in METHODS], "method string").select("method", text.verb_of(F.col("method")).alias("verb"))


@query(values("raw VARCHAR, verb VARCHAR, path VARCHAR", [("GET /users/{id}", "GET", "/users/{id}"), ("/plain", None, "/plain"), ("POST  /x", "POST", "/x"), ("get /y", None, "get /y")]))
def b9_verb_in_path(spark, sf):
    x = spark.createDataFrame([("GET /users/{id}",), ("/plain",), ("POST  /x",), ("get /y",)], "raw string")
    verb, path = text.verb_in_path(F.col("raw"))
    return x.select("raw", verb.alias("verb"), path.alias("path"))


@query(values("prefix VARCHAR, child VARCHAR, route VARCHAR", [("airports", ":id", "/airports/:id"), ("/api/", "/x/", "/api/x"), ("", "y", "/y"), ("z", "", "/z"), ("", "", "/")]))
def b10_join_route(spark, sf):
    x = spark.createDataFrame([("airports", ":id"), ("/api/", "/x/"), ("", "y"), ("z", ""), ("", "")], "prefix string, child string")
    return x.select("prefix", "child", text.joined_route(F.col("prefix"), F.col("child")).alias("route"))


@query(values("stem VARCHAR, route VARCHAR", [("users/[id]", "/users/{*}"), ("(auth)/login", "/login"), ("", "/"), ("docs/[[...slug]]", "/docs/{*}"), ("index", "/"), ("@[team]/x", "/{*}/x")]))
def b12_file_route_path(spark, sf):
    x = spark.createDataFrame([("users/[id]",), ("(auth)/login",), ("",), ("docs/[[...slug]]",), ("index",), ("@[team]/x",)], "stem string")
    return x.select("stem", text.file_route_path(F.col("stem")).alias("route"))


@query(f"WITH f AS ({FILES_SQL}) SELECT {LANG} AS lang, {EXT} IN ({q(fixed.CONFIG_EXTENSIONS)}) AS config, count(*) AS n FROM f GROUP BY ALL")
def b13_languages(spark, sf):
    return document_files(spark, sf).groupBy(text.language_of(F.col("file")).alias("lang"), text.is_config(F.col("file")).alias("config")).agg(F.count("*").alias("n"))


# names: parts' names in camel case, with suffixes that stemming must take off
def names(spark, sf):
    p = table(spark, sf, "part")
    suffix = F.element_at(F.array(*map(F.lit, ("Handlers", "Parsing", "Entries", "Boxes", "Class", "Of"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), suffix, F.lit("."), F.col("p_brand")).alias("full"), F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), suffix).alias("name"))


NAMES_SQL = """p AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || ['Handlers', 'Parsing', 'Entries', 'Boxes', 'Class', 'Of'][(p_partkey % 6 + 1)::INT] AS name FROM part)"""
STEM_SQL = """CASE WHEN length({0}) > 5 AND {0} LIKE '%ing' THEN {0}[:-4] WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN {0}[:-4] || 'y'
 WHEN length({0}) > 4 AND regexp_matches({0}, '(ches|shes|sses|xes|zes)$') THEN {0}[:-3] WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN {0}[:-2] ELSE {0} END"""


def terms_sql(c: str) -> str:
    spaced = f"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    words = f"list_filter(string_split_regex(lower({spaced}), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({q(fixed.STOP_WORDS)}))"
    stemmed = f"list_filter(list_transform({words}, lambda w: {STEM_SQL.format('w')}), lambda w: w NOT IN ({q(fixed.STOP_WORDS)}))"
    return f"list_sort(list_distinct({stemmed}))"


@query(f"WITH {NAMES_SQL} SELECT p_partkey, array_to_string({terms_sql('name')}, ',') AS terms FROM p")
def b14_identifier_terms(spark, sf):
    return names(spark, sf).select("p_partkey", F.array_join(F.sort_array(text.terms(F.col("name"))), ",").alias("terms"))


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) SELECT term, {STEM_SQL.format('term')} AS stem FROM w")
def b15_stems(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).distinct()
    return w.select("term", text.stem(F.col("term")).alias("stem"))


DICE_ASKED = "antiquehandler"


@query(f"""WITH {NAMES_SQL}, n AS (SELECT p_partkey, lower(name) AS s FROM p), q AS (SELECT '{DICE_ASKED}' AS s),
g AS (SELECT p_partkey, b, row_number() OVER (PARTITION BY p_partkey, b) AS r FROM (SELECT p_partkey, unnest(list_transform(range(1, length(s)), lambda i: s[i:i + 1])) AS b FROM n)),
h AS (SELECT b, row_number() OVER (PARTITION BY b) AS r FROM (SELECT unnest(list_transform(range(1, length(s)), lambda i: s[i:i + 1])) AS b FROM q)),
o AS (SELECT p_partkey, count(*) AS k FROM g JOIN h USING (b, r) GROUP BY p_partkey)
SELECT n.p_partkey, round(CASE WHEN n.s = '{DICE_ASKED}' THEN 1.0 ELSE 2.0 * coalesce(k, 0) / (length(n.s) + {len(DICE_ASKED)} - 2) END::DOUBLE, 6) AS dice FROM n LEFT JOIN o ON o.p_partkey = n.p_partkey""")
def b16_bigram_dice(spark, sf):
    return names(spark, sf).select("p_partkey", F.round(text.dice(F.lower("name"), F.lit(DICE_ASKED)), 6).alias("dice"))


ASKED_NAME = "antique handler parsing the thistle"


def ordered_terms_sql(c: str) -> str:
    """Terms in the order of their first occurrence."""
    spaced = f"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    words = f"list_filter(string_split_regex(lower({spaced}), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({q(fixed.STOP_WORDS)}))"
    stemmed = f"list_filter(list_transform({words}, lambda w: {STEM_SQL.format('w')}), lambda w: w NOT IN ({q(fixed.STOP_WORDS)}))"
    return f"list_filter({stemmed}, lambda w, i: list_position({stemmed}, w) = i)"


def bigrams_sql(s: str) -> str:
    pairs = f"list_transform(range(1, length({s})), lambda i: {s}[i:i + 1])"
    return f"list_transform({pairs}, lambda p, i: p || '#' || len(list_filter({pairs}[1:i], lambda o: o = p)))"


SIMILAR_SQL = f"""{NAMES_SQL}, t AS (SELECT p_partkey, name, {ordered_terms_sql('name')} AS c, {ordered_terms_sql(f"'{ASKED_NAME}'")} AS q FROM p),
j AS (SELECT *, array_to_string(c, '') AS cs, array_to_string(q, '') AS qs, len(list_intersect(c, q)) AS shared FROM t),
d AS (SELECT *, CASE WHEN cs = qs THEN 1.0 WHEN length(cs) < 2 OR length(qs) < 2 THEN 0.0 ELSE 2.0 * len(list_intersect({bigrams_sql('cs')}, {bigrams_sql('qs')})) / (length(cs) + length(qs) - 2) END AS dice FROM j),
scored AS (SELECT d.p_partkey, name, p_brand, greatest(0.72 * shared / len(q) + 0.28 * shared / greatest(len(c), 1), dice)::DOUBLE AS score FROM d JOIN part ON part.p_partkey = d.p_partkey)"""


@query(f"WITH {SIMILAR_SQL} SELECT p_partkey, round(score, 6) AS score FROM scored")
def b17_symbol_similarity(spark, sf):
    return names(spark, sf).select("p_partkey", F.round(text.similarity(F.lit(ASKED_NAME), F.col("name")), 6).alias("score"))


@query(f"WITH {NAMES_SQL}, w AS (SELECT p.p_partkey, {terms_sql('name')} AS c, {terms_sql('p_name')} AS t FROM p JOIN part ON part.p_partkey = p.p_partkey) SELECT p_partkey, len(t) > 0 AND c = t AS same FROM w")
def b18_same_terms(spark, sf):
    """Whether a part's words are all that its symbol's name says."""
    words = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return names(spark, sf).join(words, F.expr("k = p_partkey")).select("p_partkey", text.same_terms(F.col("p_name"), F.col("name")).alias("same"))


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id FROM f WHERE (file = 'src0/en' OR file LIKE 'src0/en/%') AND lower({LANG}) = 'python'")
def b19_focus_scope(spark, sf):
    f = document_files(spark, sf)
    return f.where(text.in_scope(F.col("file"), text.language_of(F.col("file")), F.lit("file"), path="@./src0/en/", language="PYTHON")).select("doc_id")


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def b20_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, greatest(256, least(16000, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END, 512)))::BIGINT AS budget FROM documents")
def b21_budget(spark, sf):
    asked = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", text.budget(asked).cast("long").alias("budget"))


@query("SELECT o_orderkey, round(pow(0.5, greatest(0, epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 86400.0 / 30.0), 6) AS recency FROM orders")
def b22_recency(spark, sf):
    from emberline.operators.cochange import age_days

    return table(spark, sf, "orders").select("o_orderkey", F.round(text.recency(age_days(F.col("o_orderdate"), F.lit("1999-01-01").cast("timestamp"))), 6).alias("recency"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN 100 + l_quantity - l_linenumber <= 0 THEN 0 ELSE least(0.5, 0.08 + 0.55 * l_linenumber / (100 + l_quantity - l_linenumber) + 0.10 * least(l_linenumber / 10.0, 1)) END::DOUBLE, 6) AS score FROM lineitem""")
def b23_pair_score(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(text.pair_score(F.col("l_linenumber"), F.lit(100), F.col("l_quantity")), 6).alias("score"))


@query("SELECT event_type, round(((count(*) FILTER (value > 50)) + 0.5) / (count(*) + 1.0), 6)::DOUBLE AS p FROM events GROUP BY event_type")
def b24_posterior(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(text.posterior(F.count_if(F.col("value") > 50), F.count("*")), 6).alias("p"))


@query("SELECT event_id, round(value * pow(0.5, greatest(0, epoch(TIMESTAMP '2024-01-20') - epoch(ts)) / 3600.0 / 48.0), 6) AS mass FROM events")
def b25_decayed_mass(spark, sf):
    hours = (F.unix_micros(F.lit("2024-01-20").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    return table(spark, sf, "events").select("event_id", F.round(text.decayed(F.col("value"), hours), 6).alias("mass"))


@query(f"WITH f AS ({FILES_SQL}) SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 <= 0 THEN file WHEN doc_id % 3 = 0 THEN file || ' (member line unavailable)' ELSE file || ':' || (doc_id % 5) END AS place FROM f")
def b28_location(spark, sf):
    f, i = document_files(spark, sf), F.col("doc_id")
    return f.select("doc_id", text.location(F.col("file"), F.when(i % 4 == 0, "file").otherwise("function"), i % 5, i % 3 == 0).alias("place"))


DIR = "CASE len(string_split(file, '/')) WHEN 1 THEN '(root)' WHEN 2 THEN string_split(file, '/')[1] || '/' ELSE string_split(file, '/')[1] || '/' || string_split(file, '/')[2] || '/' END"


@query(f"WITH f AS ({FILES_SQL}) SELECT {DIR} AS dir, count(*) AS n FROM f GROUP BY ALL")
def b29_directories(spark, sf):
    return document_files(spark, sf).groupBy(text.directory(F.col("file")).alias("dir")).agg(F.count("*").alias("n"))


MARKED_SQL = "CASE doc_id % 6 WHEN 0 THEN '@' || file WHEN 1 THEN './' || file WHEN 2 THEN '../' || file WHEN 3 THEN '/' || file WHEN 4 THEN '@././' || file ELSE file END"


@query(f"WITH f AS ({FILES_SQL}), m AS (SELECT doc_id, regexp_replace(regexp_replace({MARKED_SQL}, '^@', ''), '^(\\./)+', '') AS p FROM f) SELECT doc_id, CASE WHEN starts_with(p, '/') OR starts_with(p, '../') THEN NULL ELSE string_split(p, '/')[1] END AS scope FROM m")
def b30_sync_scope(spark, sf):
    return document_files(spark, sf).select("doc_id", text.sync_scope(F.expr(MARKED_SQL)).alias("scope"))


ASKED = [("loadUser", True), ("UserStore.load", True), ("web/api.ts", True), ("/users/{id}", True), ("foo|bar", False), ("a.*b", False), ("plain words", True), ("\\bword", False)]


@query(values("query VARCHAR, graph BOOLEAN", ASKED))
def b32_search_routing(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in ASKED], "query string").select("query", text.looks_like_symbol(F.col("query")).alias("graph"))


@query(values("name VARCHAR, pattern VARCHAR, short VARCHAR", [("a.b", "a\\.b", "b"), ("f(x)", "f\\(x\\)", "f(x)"), ("$m", "\\$m", "$m"), ("plain", "plain", "plain")]))
def b33_sanitisers(spark, sf):
    x = spark.createDataFrame([("a.b",), ("f(x)",), ("$m",), ("plain",)], "name string")
    return x.select("name", text.escaped(F.col("name")).alias("pattern"), text.short_name(F.col("name")).alias("short"))


#: Lines of code made of documents: long ones with and without a body, short ones.
CODE_SQL = "replace(substr(text, 1, CASE doc_id % 4 WHEN 3 THEN 50 ELSE 190 END), chr(10), ' ')"
CODE_SQL = f"CASE doc_id % 4 WHEN 0 THEN '  class A  {{{{ ' || {CODE_SQL} WHEN 1 THEN {CODE_SQL} WHEN 2 THEN substr({CODE_SQL}, 1, 60) || ' {{{{' || {CODE_SQL} ELSE '    ' || {CODE_SQL} || '  ' END".replace("{{", "{")


@query(f"""WITH t AS (SELECT doc_id, regexp_replace({CODE_SQL}, '^\\s+|\\s+$', '', 'g') AS s FROM documents),
c AS (SELECT doc_id, CASE WHEN strpos(s, '{{') > 1 AND length(s) > 140 THEN regexp_replace(s[:strpos(s, '{{') - 1], '\\s+$', '') || ' {{ ... }}' ELSE s END AS s FROM t)
SELECT doc_id, CASE WHEN length(s) > 140 THEN s[:137] || '...' ELSE s END AS sig FROM c""")
def a11_clean_signature(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_signature(F.expr(CODE_SQL)).alias("sig"))


@query(f"WITH f AS ({FILES_SQL}), s AS (SELECT *, {STATUS} AS status FROM f) SELECT status, count(*) AS files, count(DISTINCT {DIR}) AS dirs FROM s GROUP BY status")
def d15_coverage_report(spark, sf):
    from emberline.sources.files import coverage

    return coverage(document_files(spark, sf), max_bytes=16384).groupBy("status").agg(F.count("*").alias("files"), F.countDistinct(text.directory(F.col("file"))).alias("dirs"))


@query(f"WITH f AS ({FILES_SQL}) SELECT substr(sha1(string_agg(file || ':' || sha1(text), chr(10) ORDER BY file || ':' || sha1(text))), 1, 12) AS version FROM f WHERE doc_id % 1 = 0")
def d14_graph_version(spark, sf):
    from emberline.sources.files import version

    return version(document_files(spark, sf).select("file", F.sha1("text").alias("sha")))


@query("SELECT DISTINCT event_type AS name FROM events UNION SELECT DISTINCT lang FROM documents")
def f3_union(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("name")).unionByName(table(spark, sf, "documents").select(F.col("lang").alias("name"))).distinct()


@query("SELECT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM events WHERE value > 60")
def f4_except(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", "event_type").subtract(e.where("value > 60").select("user_id", "event_type"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT DISTINCT user_id FROM events WHERE value > 50")
def f5_intersect(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("value > 50").select("user_id"))


@query(f"SELECT file, row_number() OVER (ORDER BY file, doc_id) AS place FROM (SELECT doc_id, {PATH_SQL} AS file FROM documents)")
def f6_listing_order(spark, sf):
    from emberline.operators.ranking import global_rank

    return global_rank(document_files(spark, sf).select("file", "doc_id"), "file", "doc_id").select("file", F.col("rank").alias("place"))


@query(f"WITH {LITERALS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY node, line) AS k FROM lits) SELECT text, node, line::INT AS line FROM r WHERE k = 1")
def f2_first_wins(spark, sf):
    w = Window.partitionBy("text").orderBy("node", "line")
    return page_literals(spark, sf).withColumn("k", F.row_number().over(w)).where("k = 1").select("text", "node", "line")
