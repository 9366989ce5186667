"""Scalar functions over paths, literals, names and routes, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions import fixed


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def lookup(table: dict, key: Column) -> Column:
    """table[key], null where there is no such key."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language_of(path: Column) -> Column:
    return F.coalesce(lookup(fixed.LANGUAGES, extension(path)), F.lit("config"))


def is_config(path: Column) -> Column:
    return extension(path).isin(*fixed.CONFIG_EXTENSIONS)


def is_junk(path: Column) -> Column:
    base = F.lower(base_name(path))
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, fixed.IGNORED_DIRS))) | base.isin(*fixed.LOCK_FILES) | base.endswith(".lock")


def is_supported(path: Column) -> Column:
    ext = extension(path)
    known = ~ext.isin(*fixed.BINARY_EXTENSIONS) & ext.isin(*fixed.LANGUAGES, *fixed.CONFIG_EXTENSIONS)
    return known | path.rlike("|".join(r[1] for r in fixed.FILE_ROUTES))


def is_generated(path: Column, text: Column) -> Column:
    """By name, or by a line of LONG_LINE characters or more."""
    long = (F.length(text) >= fixed.LONG_LINE) & F.exists(F.split(text, "\n"), lambda x: F.length(x) >= fixed.LONG_LINE)
    return path.rlike(fixed.GENERATED_NAME) | long


def is_test_file(path: Column) -> Column:
    return path.rlike(fixed.TEST_FILE)


def is_test_scope(path: Column) -> Column:
    return is_test_file(path) | path.rlike(fixed.TEST_SCOPE)


def literal_class(text: Column) -> Column:
    """path, env, word or null."""
    t = trimmed(text)
    mixed = F.contains(t, F.lit(".")) | F.contains(t, F.lit("::")) | F.contains(t, F.lit("-")) | F.contains(t, F.lit("_")) | F.substring(t, 2, 1 << 30).rlike("[A-Z][a-z]")
    return (
        F.when((F.length(t) < 3) | (F.length(t) > 200), None)
        .when(t.rlike(fixed.ENV_TOKEN), "env")
        .when(F.regexp_replace(t, fixed.ORIGIN, "").rlike(fixed.PATH_TOKEN), "path")
        .when(t.rlike(fixed.WORD_TOKEN) & mixed, "word")
    )


def normal_literal(text: Column, cls: Column) -> Column:
    """The key under which equal literals of a class meet."""
    t = trimmed(text)
    parts = F.transform(F.split(F.regexp_replace(t, fixed.ORIGIN, ""), "/"), lambda s: F.when(s.rlike(fixed.PLACEHOLDER), "{*}").otherwise(s))
    joined = F.array_join(parts, "/")
    path = F.when((F.length(joined) > 1) & joined.endswith("/"), F.left(joined, F.length(joined) - 1)).otherwise(joined)
    return F.when(cls == "env", F.upper(t)).when(cls == "word", t).otherwise(path)


def stem(term: Column) -> Column:
    n = F.length(term)
    less = lambda k: F.left(term, n - k)
    return (
        F.when((n > 5) & term.endswith("ing"), less(3))
        .when((n > 4) & term.endswith("ies"), F.concat(less(3), F.lit("y")))
        .when((n > 4) & term.rlike("(ches|shes|sses|xes|zes)$"), less(2))
        .when((n > 3) & term.endswith("s") & ~term.endswith("ss"), less(1))
        .otherwise(term)
    )


def terms(name: Column) -> Column:
    """Distinct stemmed terms of an identifier or a question."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    told = lambda w: ~w.isin(*fixed.STOP_WORDS)
    words = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & told(w))
    return F.array_distinct(F.filter(F.transform(words, stem), told))


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row. Within lambdas Spark computes an expression anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _bigrams(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))


def _shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    count = lambda x, of: F.size(of) - F.size(F.array_remove(of, x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(x, a), count(x, b)))


def dice(a: Column, b: Column) -> Column:
    """Multiset overlap of bigrams, 0 to 1."""

    def of(s: Column) -> Column:
        shared = _bound(F.struct(_bigrams(s["a"]).alias("a"), _bigrams(s["b"]).alias("b")), lambda g: _shared(g["a"], g["b"]))
        return F.when(s["a"] == s["b"], 1.0).when((F.length(s["a"]) < 2) | (F.length(s["b"]) < 2), 0.0).otherwise(2.0 * shared / (F.length(s["a"]) + F.length(s["b"]) - 2))

    return _bound(F.struct(a.alias("a"), b.alias("b")), of)


def similarity(query: Column, name: Column) -> Column:
    """How well a symbol's name answers a query."""

    def of(t: Column) -> Column:
        q, c = t["q"], t["c"]
        shared = F.size(F.array_intersect(q, c))
        share = lambda of: F.when(F.size(of) > 0, shared / F.size(of)).otherwise(0.0)
        return F.greatest(0.72 * share(q) + 0.28 * share(c), dice(F.array_join(q, ""), F.array_join(c, "")))

    return _bound(F.struct(terms(query).alias("q"), terms(short_name(name)).alias("c")), of)


def same_terms(query: Column, name: Column) -> Column:
    q, c = terms(query), terms(short_name(name))
    return (F.size(q) > 0) & (F.size(q) == F.size(c)) & F.forall(q, lambda t: F.array_contains(c, t))


def scope_path(path: str) -> str:
    """A focus scope's path without its leading marks and its trailing slash."""
    path = path.removeprefix("@").removeprefix("./")
    return path.removesuffix("/")


def in_scope(file: Column, lang: Column, kind: Column, path: str | None = None, language: str | None = None, of_kind: str | None = None) -> Column:
    ok = F.lit(True)
    if path and (p := scope_path(path)):
        ok = ok & ((file == p) | file.startswith(p + "/"))
    if language:
        ok = ok & (F.lower(lang) == language.lower())
    if of_kind:
        ok = ok & (kind == of_kind)
    return ok


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def budget(asked: Column) -> Column:
    return F.greatest(F.lit(256), F.least(F.lit(16000), F.coalesce(asked, F.lit(512))))


def recency(age_days: Column, half_life: float = fixed.RECENCY_DAYS) -> Column:
    return F.pow(F.lit(0.5), age_days / F.lit(half_life))


def pair_score(n: Column, solo_a: Column, solo_b: Column) -> Column:
    union = solo_a + solo_b - n
    return F.when(union <= 0, 0.0).otherwise(F.least(F.lit(0.5), 0.08 + 0.55 * n / union + 0.10 * F.least(n / 10, F.lit(1.0))))


def posterior(path_n: Column, n: Column) -> Column:
    return (path_n + 0.5) / (n + 1.0)


def decayed(mass: Column, age_hours: Column, half_life: float = fixed.HALF_LIFE_HOURS) -> Column:
    return mass * F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / F.lit(half_life))


def location(file: Column, kind: Column, line: Column, approximate: Column) -> Column:
    return F.when((kind == "file") | (line <= 0), file).when(approximate, F.concat(file, F.lit(" (member line unavailable)"))).otherwise(F.concat_ws(":", file, line.cast("string")))


def directory(file: Column) -> Column:
    parts = F.split(file, "/")
    return F.when(F.size(parts) == 1, "(root)").when(F.size(parts) == 2, F.concat(parts[0], F.lit("/"))).otherwise(F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/")))


def sync_scope(path: Column) -> Column:
    """First segment of a repository path that is normal already; null if it leaves the root."""
    bare = F.regexp_replace(F.regexp_replace(path, "^@", ""), r"^(?:\./)+", "")
    return F.when(bare.isNull() | (bare == "") | (bare == ".") | bare.rlike(r"^/|^\.\.(?:/|$)"), None).otherwise(F.split_part(bare, F.lit("/"), F.lit(1)))


def clean_signature(line: Column) -> Column:
    t = trimmed(line)
    brace = F.instr(t, "{")
    cut = F.when((brace > 1) & (F.length(t) > 140), F.concat(F.regexp_replace(F.left(t, brace - 1), r"\s+$", ""), F.lit(" { ... }"))).otherwise(t)
    return F.when(F.length(cut) > 140, F.concat(F.left(cut, F.lit(137)), F.lit("..."))).otherwise(cut)


def unquote(text: Column) -> Column:
    t = trimmed(text)
    inner = F.regexp_extract(t, r"(?s)^[rbfuRBFU]{0,3}([\"'`])(.*)\1$", 2)
    return F.when(t.rlike(r"(?s)^[rbfuRBFU]{0,3}([\"'`]).*\1$"), inner).otherwise(t)


def verb_of(method: Column) -> Column:
    up = F.upper(method)
    up = F.when(up.endswith("MAPPING"), F.left(up, F.length(up) - 7)).otherwise(up)
    return F.coalesce(lookup(fixed.METHOD_ALIASES, up), up)


def verb_in_path(raw: Column) -> tuple[Column, Column]:
    """The verb written inside a path (null if none), and the path without it."""
    has = raw.rlike(fixed.VERB_IN_PATH)
    return F.when(has, F.regexp_extract(raw, fixed.VERB_IN_PATH, 1)), F.when(has, F.regexp_extract(raw, fixed.VERB_IN_PATH, 2)).otherwise(raw)


def joined_route(prefix: Column, child: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    p, c = bare(prefix), bare(child)
    return F.concat(F.lit("/"), F.when(c == "", p).when(p == "", c).otherwise(F.concat_ws("/", p, c)))


def file_route_path(stem_: Column) -> Column:
    """The route that a file's stem stands for."""
    kept = F.filter(F.split(stem_, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.+\)$") & (s != "index"))
    return F.concat(F.lit("/"), F.array_join(F.transform(kept, lambda s: F.when(s.rlike(r"^@?\[+(?:\.\.\.)?[^\]]+\]+$"), "{*}").otherwise(s)), "/"))


def looks_like_symbol(query: Column) -> Column:
    """Whether the graph can answer a search: plain words, qualified symbols, repository paths and routes."""
    return (
        ~query.rlike(r"[\\^$.*+?()\[\]{}|]")
        | query.rlike(r"^[A-Za-z_$][\w$]*(?:[.#:][A-Za-z_$][\w$]*)+$")
        | query.rlike(r"^(?:\./)?[\w@.-]+(?:/[\w@.{}:$-]+)+$")
        | query.rlike(r"^/[\w@.{}:$/-]+$")
    )


def escaped(name: Column) -> Column:
    """name as a regular expression that matches itself."""
    return F.regexp_replace(name, r"[.*+?^${}()|\[\]\\]", r"\\$0")
