"""Graph assembly: what sites lie in, what names, imports and routes resolve to, and the edges that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import is_test_file


def enclosing(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites (site, file, line) with idx, the symbol of the file that starts last at or before the line; null if none
    does. symbols: file, line, idx, pos; of one line the last by pos counts. One pass over each file's rows in order
    of lines, instead of an inequality join."""
    s = symbols.select("file", "line", F.lit(0).alias("tag"), "pos", "idx", F.lit(None).cast("long").alias("site"))
    x = sites.select("file", "line", F.lit(1).alias("tag"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("idx"), "site")
    w = Window.partitionBy("file").orderBy("line", "tag", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.unionByName(x).withColumn("found", F.last("idx", ignorenulls=True).over(w)).where("tag = 1").select("site", "file", "line", F.col("found").alias("idx"))


def name_keys(defs: DataFrame) -> DataFrame:
    """key, idx, file: a definition under its name and under what follows its first dot. defs: idx, file, name."""
    low = F.lower("name")
    dot = F.instr(low, ".")
    keys = F.array_distinct(F.filter(F.array(low, F.when(dot > 1, F.substr(low, dot + 1))), lambda k: k.isNotNull() & (k != "")))
    return defs.select("idx", "file", F.explode(keys).alias("key"))


def resolve_calls(calls: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """call, to, w. calls: call, file, callee; imports: file, target. A name of over MAX_CANDIDATES definitions is
    noise; that gate precedes the join and bounds it. Definitions in the same file come first, then those in imported
    files, then a single one anywhere; over MAX_CHOSEN are none."""
    keys = name_keys(defs)
    n = keys.groupBy("key").agg(F.count("*").alias("cands")).where(F.col("cands") <= fixed.MAX_CANDIDATES).toDF("n_key", "cands")
    cand = keys.join(n, keys["key"] == n["n_key"]).select(F.col("key").alias("c_key"), F.col("idx").alias("to"), F.col("file").alias("def_file"), "cands")
    x = calls.join(cand, F.lower(calls["callee"]) == cand["c_key"]).select("call", "file", "to", "def_file", "cands")
    i = imports.select(F.col("file").alias("i_file"), F.col("target").alias("i_target")).distinct()
    x = x.join(i, (x["file"] == i["i_file"]) & (x["def_file"] == i["i_target"]), "left")
    tier = F.when(F.col("def_file") == F.col("file"), 0).when(F.col("i_target").isNotNull(), 1).when(F.col("cands") == 1, 2)
    x = x.withColumn("tier", tier).where("tier is not null")
    per = Window.partitionBy("call")
    x = x.withColumn("best", F.min("tier").over(per)).where("tier = best").withColumn("chosen", F.count("*").over(per)).where(F.col("chosen") <= fixed.MAX_CHOSEN)
    w = F.when(F.col("cands") <= 8, 0.7).when(F.col("cands") <= 24, 0.45).otherwise(0.25)
    return x.select("call", "to", w.alias("w"))


def normal_path(path: Column) -> Column:
    """path without . and .. segments."""
    step = lambda a, s: F.when(s.isin("", "."), a).when((s == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


FAMILY = {"ts": "ts", "tsx": "ts", "mts": "ts", "cts": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "py": "py", "go": "go", "rs": "rs"}
# Endings tried for a relative import, in this order.
ENDINGS = {"ts": (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"), "py": (".py",), "go": (".go",), "rs": (".rs",)}


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, spec, target: the first candidate path that exists; names that several files could mean only count if one
    does. imports: file, spec; files: file."""
    from emberline.functions.text import extension, lookup

    x = imports.select("file", "spec").distinct().withColumn("family", F.coalesce(lookup(FAMILY, extension(F.col("file"))), F.lit("ts")))
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    relative = F.col("spec").rlike(r"^\.\.?/")
    base = F.regexp_replace(normal_path(F.concat_ws("/", folder, "spec")), r"\.(?:[cm]?js|jsx)$", "")
    tried = F.array().cast("array<string>")
    for fam, ends in ENDINGS.items():
        tried = F.when(F.col("family") == fam, F.array(*(F.concat(base, F.lit(e)) for end in ends for e in (end, f"/index{end}")), base)).otherwise(tried)
    dotted = F.replace(F.col("spec"), F.lit("."), F.lit("/"))
    crate = F.replace(F.regexp_replace("spec", "^crate::|^self::", ""), F.lit("::"), F.lit("/"))
    exact = F.when(relative, tried).when(F.col("family") == "py", F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))).when(F.col("family") == "rs", F.array(F.concat(F.lit("src/"), crate, F.lit(".rs")), F.concat(crate, F.lit(".rs")))).otherwise(F.array().cast("array<string>"))
    f = files.select(F.col("file").alias("f_file"))
    hits = x.select("file", "spec", F.posexplode(exact).alias("rank", "path"))
    by_path = hits.join(f, hits["path"] == f["f_file"]).groupBy("file", "spec").agg(F.min_by("path", "rank").alias("target"))

    # names that must mean one file: (family, key, target), ranked; a key counts if it has one target
    dirs = files.select("file", F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("dir")).where("dir <> ''").groupBy("dir").agg(F.min("file").alias("first"))
    suffix = lambda d, k: F.array_join(F.slice(F.split(d, "/"), -k, k), "/")
    go = None
    for k in (1, 2, 3):
        own = dirs.where(F.size(F.split("dir", "/")) >= k).select(F.lit("go").alias("fam"), F.lit(k).alias("k"), suffix(F.col("dir"), k).alias("key"), F.col("first").alias("to"))
        go = own if go is None else go.unionByName(own)
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    up = F.regexp_extract("file", r"([^/]+)/[^/]*$", 1)
    rs = files.where(F.col("file").endswith(".rs")).select(F.lit("rs").alias("fam"), F.lit(1).alias("k"), F.when((stem == "mod") & (up != ""), up).otherwise(stem).alias("key"), F.col("file").alias("to"))
    tails = F.regexp_replace("file", r"(?:/index)?\.ts$", "")
    ts = files.where(F.col("file").endswith(".ts")).select("file", F.split(tails, "/").alias("s")).select(F.lit("ts").alias("fam"), F.lit(1).alias("k"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col("s"), F.size("s") - i + 1, i), "/"))).alias("key"), F.col("file").alias("to")).where(F.instr("to", "/") > 0)
    unique = go.unionByName(rs).unionByName(ts).groupBy("fam", "k", "key").agg(F.count("*").alias("n"), F.min("to").alias("to")).where("n = 1")
    segs = F.filter(F.split("spec", "/"), lambda s: s != "")
    asked = F.when(F.col("family") == "go", F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.greatest(F.size(segs), F.lit(1)))), lambda k: F.struct(k.alias("ak"), F.array_join(F.slice(segs, F.size(segs) - k + 1, k), "/").alias("akey")))).when(F.col("family") == "rs", F.array(F.struct(F.lit(1).alias("ak"), F.element_at(F.split(crate, "/"), -1).alias("akey")))).when(F.col("family") == "ts", F.array(F.struct(F.lit(1).alias("ak"), F.array_join(segs, "/").alias("akey"))))
    y = x.where(~relative).select("file", "spec", F.col("family").alias("a_fam"), F.explode(asked).alias("q")).select("file", "spec", "a_fam", "q.*")
    by_name = y.join(unique, (y["a_fam"] == unique["fam"]) & (y["ak"] == unique["k"]) & (y["akey"] == unique["key"])).groupBy("file", "spec").agg(F.min_by("to", "ak").alias("target"))
    both = by_path.withColumn("r", F.lit(0)).unionByName(by_name.withColumn("r", F.lit(1)))
    return both.groupBy("file", "spec").agg(F.min_by("target", "r").alias("target")).where("target <> file")


def test_wiring(targets: DataFrame) -> DataFrame:
    """file, target of what test files import. targets: file, target."""
    return targets.where(is_test_file(F.col("file")))


def inherited(classes: DataFrame, defs: DataFrame) -> DataFrame:
    """idx, to: classes and what they extend or implement. classes: idx, sig."""
    extends = F.expr(r"regexp_extract_all(sig, 'extends\\s+([A-Za-z_$][\\w$.]*)', 1)")
    implements = F.split(F.regexp_extract("sig", r"implements\s+([A-Za-z_$][\w$.,\s]*)", 1), ",")
    names = F.filter(F.transform(F.concat(extends, implements), lambda n: F.lower(F.regexp_replace(n, r"^\s+|\s+$", ""))), lambda n: n != "")
    x = classes.select(F.col("idx").alias("a"), F.explode(names).alias("name_key"))
    k = name_keys(defs)
    return x.join(k, x["name_key"] == k["key"]).where("a <> idx").select(F.col("a").alias("idx"), F.col("idx").alias("to"))


def anchor_hubs(sites: DataFrame) -> DataFrame:
    """One row per route: id, kind, label, file, line, node, sites, files, implicit, w and file_w (null but for 2 to 12
    files). sites: id, kind, node, file, line, implicit, pos."""
    hub = sites.groupBy("id").agg(
        F.min_by(F.struct("kind", "node", "file", "line"), F.col("pos")).alias("first"), F.count("*").alias("sites"), F.countDistinct("file").alias("files"), F.bool_and(F.coalesce("implicit", F.lit(False))).alias("implicit")
    )
    label = F.when(F.col("sites") > 1, F.concat("id", F.lit(" · "), F.col("sites").cast("string"), F.lit(" sites"))).otherwise(F.col("id"))
    return hub.select(
        "id", "first.kind", label.alias("label"), "first.file", "first.line", "first.node", "sites", "files", "implicit",
        (F.when(F.col("implicit"), 0.5).otherwise(1.0) / F.sqrt("sites")).alias("w"), F.when(F.col("files").between(2, 12), 0.35 / F.sqrt("files")).alias("file_w"),
    )


def hub_edges(sites: DataFrame, hubs: DataFrame) -> DataFrame:
    """id, node or file, w: a route's handlers, one edge per site, and the files that it binds."""
    h = hubs.select(F.col("id").alias("h_id"), "w", "file_w")
    x = sites.join(h, sites["id"] == h["h_id"])
    handlers = x.select("id", "node", F.lit(None).cast("string").alias("file"), "w")
    bound = x.where("file_w is not null").select("id", "file", "file_w").distinct().select("id", F.lit(None).cast(dict(sites.dtypes)["node"]).alias("node"), "file", F.col("file_w").alias("w"))
    return handlers.unionByName(bound)
