"""Facts of source texts: symbols, imports, calls, literals, routes.

Texts are split into comments, strings and the rest by one regular expression of each language, in the JVM (see stripped).
Comments count for nothing and calls in strings aren't calls. Imports and routes may span lines: they are looked for in the
whole text, with its line numbers put in as marks. Python's symbols come from its own parser; elsewhere declarations count
where they start a line, and members one pair of braces further in. Regular expression literals and heredocs aren't known:
their quotes count as quotes.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import clean_signature, file_route_path, is_config, joined_route, language_of, normal_literal, unquote, verb_in_path, verb_of

# Declarations by language: pattern, kind, group of the parent (0: none), group of the name.
_SCRIPT = (
    (r"\bclass\s+([A-Za-z_$][\w$]*)", "class", 0, 1),
    (r"\binterface\s+([A-Za-z_$][\w$]*)", "interface", 0, 1),
    (r"\benum\s+([A-Za-z_$][\w$]*)", "type", 0, 1),
    (r"\btype\s+([A-Za-z_$][\w$]*)", "type", 0, 1),
    (r"\bfunction\s+([A-Za-z_$][\w$]*)", "function", 0, 1),
    (r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)", "function", 0, 1),
)
_C = ((r"^[A-Za-z_][\w\s*]*?\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{?", "function", 0, 1), (r"^\s*(?:struct|enum|union)\s+([A-Za-z_]\w*)", "class", 0, 1))
_JVM = ((r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)", "class", 0, 1),)
DECLARATIONS = {
    "TypeScript": _SCRIPT, "JavaScript": _SCRIPT, "Tsx": _SCRIPT,
    "Go": (
        (r"^func\s*\(\s*\w+\s+\*?([A-Za-z_]\w*)\s*\)\s*([A-Za-z_]\w*)", "method", 1, 2),
        (r"^func\s+([A-Za-z_]\w*)", "function", 0, 1),
        (r"^type\s+([A-Za-z_]\w*)\s+struct", "class", 0, 1),
        (r"^type\s+([A-Za-z_]\w*)\s+interface", "interface", 0, 1),
        (r"^type\s+([A-Za-z_]\w*)", "type", 0, 1),
    ),
    "Rust": ((r"\bfn\s+([A-Za-z_]\w*)", "function", 0, 1), (r"\bstruct\s+([A-Za-z_]\w*)", "class", 0, 1), (r"\b(?:trait|enum|mod)\s+([A-Za-z_]\w*)", "type", 0, 1)),
    "Elixir": ((r"^\s*defmodule\s+([\w.]+)", "class", 0, 1), (r"^\s*defprotocol\s+([\w.]+)", "interface", 0, 1), (r"^\s*def(?:p|macro|macrop)?\s+([a-z_]\w*[!?=]?)", "function", 0, 1)),
    "Ruby": ((r"^\s*(?:class|module)\s+([\w:]+)", "class", 0, 1), (r"^\s*def\s+(?:self\.)?([\w!?=]+)", "function", 0, 1)),
    "C": _C, "C++": _C, "Java": _JVM, "Kotlin": _JVM, "Lua": ((r"\bfunction\s+([\w.:]+)", "function", 0, 1),),
}

# Routes by call shape: id, languages, pattern, methods, prefix pattern, what else holds.
ANCHOR_RULES = (
    ("http-route-call", ("TypeScript", "Tsx", "JavaScript", "Go"), "$R.$M($P, $$$H)", "^(?i:get|post|put|delete|patch|head|options|all|use|any|handle|handlefunc|route|group)$", "", ""),
    ("http-verb-single-arg", ("TypeScript", "Tsx", "JavaScript"), "$R.$M($P)", "^(?i:get|post|put|delete|patch)$", "", ""),
    ("http-verb-single-arg-py", ("Python",), "$R.$M($P)", "^(get|post|put|delete|patch|head|options)$", "", ""),
    ("python-route-call", ("Python",), "$R.$M($P, $$$H)", "^(?:add_)?(?:get|post|put|delete|patch|head|options|route)$", "", ""),
    ("ts-http-decorator", ("TypeScript", "Tsx"), "@$M($P)", "^(?i:get|post|put|delete|patch|options|head)$", "@Controller($P)", ""),
    ("python-decorator-route", ("Python",), "@$R.$M($P)", "^(get|post|put|delete|patch|route|websocket)$", "", ""),
    ("verb-as-argument", ("Go", "Python", "TypeScript", "Tsx", "JavaScript"), '$R.$M("$V", "$P", $$$H)', "^(?i:method|methodfunc|add_route|add_view|route)$", "", "verb"),
    ("verb-as-argument-norecv", ("Python",), '$M("$V", "$P", $$$H)', "^route$", "", "verb"),
    ("django-url", ("Python",), '$M("$P", $$$H)', "^(path|re_path|url)$", "", "mount"),
    ("rails-route-macro", ("Ruby",), '$M "$P", $$$R', "^(get|post|put|delete|patch|match|redirect|mount|root|head|options)$", "", ""),
    ("rails-route-macro-sq", ("Ruby",), "$M '$P', $$$R", "^(get|post|put|delete|patch|match|redirect|mount|root|head|options)$", "", ""),
    ("phoenix-route-macro", ("Elixir",), '$M "$P", $$$R', "^(get|post|put|delete|patch|head|options|forward|resources)$", "", ""),
    ("phoenix-route-call", ("Elixir",), '$M("$P", $$$R)', "^(get|post|put|delete|patch|head|options|forward|resources)$", "", ""),
    ("ktor-routing-dsl", ("Kotlin",), '$M("$P") { $$$B }', "^(get|post|put|delete|patch|head|options|route)$", "", ""),
    ("spring-mapping-annotation", ("Java", "Kotlin"), '@$M("$P")', "^(Get|Post|Put|Delete|Patch)Mapping$", '@RequestMapping("$P")', ""),
    ("flask-add-url-rule", ("Python",), "$R.add_url_rule($P, $$$H)", "^add_url_rule$", "", ""),
    ("fetch-bare", ("TypeScript", "Tsx", "JavaScript"), "$M($P, $$$H)", "^fetch$", "", ""),
    ("ktor-respond-redirect", ("Kotlin",), "$R.$M($P, $$$H)", "^respondRedirect$", "", ""),
    ("rust-router-chain", ("Rust",), '$R.route("$P", $$$H)', "^route$", "", ""),
)

# What isn't code: per language the patterns of comments and of strings. Possessive, so that long texts need no stack.
_SLASH, _HASH = r"//[^\n]*+|/\*.*?(?:\*/|\z)", r"#[^\n]*+"
_DOUBLE, _SINGLE = (rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in "\"'")
_LONG, _TRIPLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"\"{3}.*?\"{3}|'{3}.*?'{3}"
_TICK, _RAW, _CHAR = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`", r"`[^`]*+`", r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"
_PLAIN = f"{_DOUBLE}|{_SINGLE}"
SYNTAX = {
    **dict.fromkeys(("TypeScript", "Tsx", "JavaScript"), (_SLASH, f"{_PLAIN}|{_TICK}")),
    **dict.fromkeys(("C", "C++"), (_SLASH, f"{_DOUBLE}|{_CHAR}")),
    **dict.fromkeys(("Java", "Kotlin", "Scala", "Swift"), (_SLASH, f"{_TRIPLE}|{_DOUBLE}|{_CHAR}")),
    "Go": (_SLASH, f"{_DOUBLE}|{_RAW}|{_CHAR}"), "Rust": (_SLASH, f"{_LONG}|{_CHAR}"), "Php": (f"{_SLASH}|{_HASH}", _PLAIN),
    "Python": (_HASH, f"{_TRIPLE}|{_PLAIN}"), "Elixir": (_HASH, f"{_TRIPLE}|{_PLAIN}"), "Ruby": (_HASH, _PLAIN), "Lua": (r"--\[\[.*?(?:\]\]|\z)|--[^\n]*+", _PLAIN),
}
# A line's number, after what it marks.
_MARK = "\x01(\\d+)\x02"

KEYWORDS = ("if", "for", "while", "switch", "return", "function", "def", "func", "fn", "catch", "elif", "match", "when", "with", "and", "or", "not", "await", "defer", "go", "class", "sizeof", "synchronized", "import", "in", "yield", "typeof")

# Members: by language, patterns of what owns them and of methods and fields.
_WORDS = r"(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set)\s+)*"
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_SCRIPT_MEMBERS = (r"\b(?:class|interface)\s+([A-Za-z_$][\w$]*)", rf"{_WORDS}[*#]?([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\??\s*\(", rf"{_WORDS}#?([A-Za-z_$][\w$]*)\s*[?!]?\s*(?:[:=;,]|$)")
MEMBERS = {
    **dict.fromkeys(("TypeScript", "Tsx", "JavaScript"), _SCRIPT_MEMBERS),
    "Java": (r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)", r"(?:[\w.<>\[\],?&]+\s+)*([A-Za-z_]\w*)\s*\(", r"(?:[\w.<>\[\],?&]+\s+)+([A-Za-z_]\w*)\s*(?:[=;]|$)"),
    "Kotlin": (r"\b(?:class|interface|object)\s+([A-Za-z_]\w*)", r"(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?([A-Za-z_]\w*)\s*\(", r"(?:\w+\s+)*va[lr]\s+([A-Za-z_]\w*)"),
    "Go": (r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b", r"([A-Za-z_]\w*)\s*\(", r"([A-Za-z_]\w*)(?:\s*,\s*\w+)*\s+[\w*\[.]"),
    "Rust": (rf"^(?:{_PUB}(?:struct|trait)|(?:unsafe\s+)?impl\b(?:<[^>]*>)?(?:.*\bfor)?)\s+([A-Za-z_]\w*)", rf"{_PUB}(?:(?:async|const|unsafe)\s+)*fn\s+([A-Za-z_]\w*)", rf"{_PUB}([a-z_]\w*)\s*:"),
}
_DECORATORS = re.compile(r"\s*(?:@[\w.]+(?:\([^()]*\))?\s*)*")


def stripped(files: DataFrame) -> DataFrame:
    """files with lang, and two more forms of text, with the same lines: code, without comments, and bare, where strings are
    empty, too (but for what templates put in)."""
    x = files.withColumn("lang", language_of(F.col("file"))).withColumn("text", F.translate("text", "\x01\x02", ""))
    code = bare = F.col("text")
    for comment, string in dict.fromkeys(SYNTAX.values()):
        of = F.col("lang").isin(*(k for k, v in SYNTAX.items() if v == (comment, string)))
        tokens = F.regexp_extract_all("text", F.lit(f"(?s){comment}|{string}|[^\"'`/#-]++|."), F.lit(0))
        blank = lambda t: F.concat(F.lit(" "), F.regexp_replace(t, r"[^\n]++", ""))
        kept = lambda t: F.array_join(F.regexp_extract_all(t, F.when(t.startswith("`"), r"\$\{[^{}]*\}|\n").otherwise(r"\n"), F.lit(0)), "")
        whole = lambda p: f"(?s)\\A(?:{p})\\z"
        clean = F.transform(tokens, lambda t: F.when(t.rlike(whole(comment)), blank(t)).otherwise(t))  # noqa: B023
        code = F.when(of, F.array_join(clean, "")).otherwise(code)
        plain = lambda t: F.when(t.rlike(whole(string)), F.concat(F.left(t, F.lit(1)), kept(t), F.left(t, F.lit(1)))).otherwise(t)  # noqa: E731, B023
        bare = F.when(of, F.array_join(F.transform(clean, plain), "")).otherwise(bare)
    return x.withColumn("code", code).withColumn("bare", bare)


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """file, lang, config, n, line. files: file, and the texts."""
    x = files.select("file", language_of(F.col("file")).alias("lang"), is_config(F.col("file")).alias("config"), F.posexplode(F.split(text, "\n")).alias("k", "line"))
    return x.select("file", "lang", "config", (F.col("k") + 1).alias("n"), "line")


def marked(text: str, pattern: str) -> Column:
    """The text with the line's number after each match of the pattern."""
    number = lambda k: F.concat(F.lit("$0\x01"), (k + 1).cast("string"), F.lit("\x02"))
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, k: F.regexp_replace(line, F.lit(pattern), number(k))), "\n")


def declared(line: Column, lang: Column) -> Column:
    """name and kind that a line declares in its language, by the first pattern that matches; null if none does."""
    out = F.lit(None).cast("struct<name:string,kind:string>")
    for of, rules in DECLARATIONS.items():
        each = F.lit(None).cast("struct<name:string,kind:string>")
        for pattern, kind, parent, name in reversed(rules):
            got = F.regexp_extract(line, pattern, name)
            full = F.concat_ws(".", F.regexp_extract(line, pattern, parent), got) if parent else got
            each = F.when(line.rlike(pattern), F.struct(full.alias("name"), F.lit(kind).alias("kind"))).otherwise(each)
        out = F.when(lang == of, each).otherwise(out)
    return out


def signature_name(sig: Column, lang: Column) -> Column:
    """name and kind of a signature: as declared, else its first word."""
    first = F.regexp_replace(F.regexp_extract(F.trim(sig), r"^([^\s(:={]*)", 1), r"^[*&]+", "")
    return F.coalesce(declared(sig, lang), F.struct(F.when(first == "", "?").otherwise(first).alias("name"), F.lit("decl").alias("kind")))


SYMBOLS = "file string, name string, kind string, line int, sig string, lang string"


def _python(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Symbols of Python sources; a text that doesn't parse has none."""
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
    for batch in batches:
        rows = []
        for file, text in zip(batch["file"], batch["text"], strict=True):
            text = text or ""
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError):
                continue
            source = text.split("\n")
            for node in tree.body:
                if type(node) in kinds:
                    rows.append((file, node.name, kinds[type(node)], node.lineno, source[node.lineno - 1]))
                    if isinstance(node, ast.ClassDef):
                        rows += [(file, f"{node.name}.{x.name}", "method", x.lineno, source[x.lineno - 1]) for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
                elif isinstance(node, ast.Assign | ast.AnnAssign):
                    rows += [(file, t.id, "decl", node.lineno, source[node.lineno - 1]) for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]
        yield pd.DataFrame([(*r, "Python") for r in rows], columns=["file", "name", "kind", "line", "sig", "lang"])


def _members(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of classes, interfaces and structures: what stands one pair of braces inside them, outside other brackets."""
    rules = {lang: tuple(map(re.compile, patterns)) for lang, patterns in MEMBERS.items()}
    for batch in batches:
        rows = []
        for file, lang, code, bare in zip(batch["file"], batch["lang"], batch["code"], batch["bare"], strict=True):
            owns, method, field = rules[lang]
            owner, braces, others = None, 0, 0
            for n, (line, shown) in enumerate(zip((bare or "").split("\n"), (code or "").split("\n"), strict=True), 1):
                if braces == others == 0 and (m := owns.search(line)):
                    owner = m[1]
                elif braces == 1 and others == 0 and owner:
                    at = _DECORATORS.match(line).end()
                    for pattern, kind in ((method, "method"), (field, "field")):
                        if (m := pattern.match(line, at)) and m[1] not in KEYWORDS:
                            rows.append((file, f"{owner}.{m[1]}", kind, n, shown[_DECORATORS.match(shown).end() :].strip().removesuffix(";"), lang))
                            break
                braces = max(braces + line.count("{") - line.count("}"), 0)
                others = max(others + line.count("(") + line.count("[") - line.count(")") - line.count("]"), 0)
                if braces == 0 and re.search("[;}]", line):
                    owner = None
        yield pd.DataFrame(rows, columns=["file", "name", "kind", "line", "sig", "lang"])


def symbols(files: DataFrame) -> DataFrame:
    """file, name, kind, line, sig, lang: the first declaration of each name in each file."""
    x = stripped(files.where(language_of(F.col("file")) != "Python"))
    top = lines(x, "code").where((F.col("lang") == "Ruby") | (F.col("lang") == "Elixir") | ~F.col("line").rlike(r"^\s"))
    plain = top.withColumn("d", declared(F.col("line"), F.col("lang"))).where("d is not null").select("file", "d.name", "d.kind", F.col("n").alias("line"), F.col("line").alias("sig"), "lang")
    inner = x.where(F.col("lang").isin(*MEMBERS)).select("file", "lang", "code", "bare").mapInPandas(_members, SYMBOLS)
    parsed = files.where(language_of(F.col("file")) == "Python").select("file", "text").mapInPandas(_python, SYMBOLS)
    both = plain.unionByName(inner).unionByName(parsed)
    first = both.groupBy("file", "name").agg(F.min_by(F.struct("kind", "line", "sig", "lang"), F.col("line")).alias("s"))
    return first.select("file", "name", "s.kind", "s.line", clean_signature(F.col("s.sig")).alias("sig"), "s.lang")


def _all(pattern: str, group: int = 1, column: str | Column = "line") -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def _each(text: Column, pattern: str, **groups: int) -> Column:
    """The matches of a pattern in a text, as structs of the named groups."""
    return F.transform(_all(pattern, 0, text), lambda hit: F.struct(*(F.regexp_extract(hit, pattern, g).alias(name) for name, g in groups.items())))


def imports(files: DataFrame) -> DataFrame:
    """file, spec, line: that of the statement, however many lines it takes."""
    at, start = marked("code", r"\b(?:import|export|require)\b"), marked("code", "^")
    script = F.concat(
        _each(at, rf"""\b(?:import|export){_MARK}\s[^"'`;()=\x01]*?\bfrom\s*["']([^"'\n]+)["']""", line=1, spec=2),
        _each(at, rf"""\b(?:import|require){_MARK}\s*\(?\s*["']([^"'\n]+)["']""", line=1, spec=2),
    )
    block = rf"""(?m)^{_MARK}[ \t]*+import\s*\(([^)]*+)\)"""
    inside = F.flatten(F.transform(_each(start, block, line=1, specs=2), lambda b: F.transform(_all(r'"([^"\n]+)"', 1, b["specs"]), lambda s: F.struct(b["line"].alias("line"), s.alias("spec")))))
    go = F.concat(_each(start, rf"""(?m)^{_MARK}[ \t]*+import\s+(?:[\w.]+\s+)?"([^"\n]+)\"""", line=1, spec=2), inside)
    python = _each(start, rf"(?m)^{_MARK}[ \t]*+(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import\b)", line=1, spec=2, other=3)
    python = F.transform(python, lambda m: F.struct(m["line"].alias("line"), F.concat(m["spec"], m["other"]).alias("spec")))
    rust = _each(start, rf"(?m)^{_MARK}[ \t]*+(?:pub(?:\([^)\n]*\))?\s+)?use\s+([\w:]+?)(?:::\{{[^;]*+|::\*|\s+as\s+\w+)?\s*;", line=1, spec=2)
    found = F.when(F.col("lang").isin("TypeScript", "Tsx", "JavaScript"), script).when(F.col("lang") == "Go", go).when(F.col("lang") == "Python", python).when(F.col("lang") == "Rust", rust)
    return stripped(files).select("file", F.explode(found).alias("f")).select("file", F.regexp_replace("f.spec", _MARK, "").alias("spec"), F.col("f.line").cast("int").alias("line")).where("spec <> ''").distinct()


def calls(files: DataFrame) -> DataFrame:
    """file, line, callee: every call, repeats kept. What declares a function isn't a call of it."""
    named = r"\b(?:def|defp|defmacrop?|func|fun|fn|function|class)\s+(?:\([^)\n]*\)\s*)?[\w.:]+[ \t]*\("
    body = r"(?<!\bnew )\b(?!(?:if|for|while|switch|catch)\b)[A-Za-z_$][\w$]*+[ \t]*+\((?=[^()]*+\)\s*(?:(?::|throws\b)[^{}=;()]*+)?\{)"
    typed = r"(?m)^[ \t]*+[A-Za-z_$][\w$]*+[ \t]*+\((?=[^()]*+\)\s*:)"
    result = r"(?m)^[ \t]++[A-Za-z_]\w*+[ \t]*+\((?=[^()\n]*+\)[ \t]++[\w*\[(])"
    script, code = F.col("lang").isin("TypeScript", "Tsx", "JavaScript"), F.col("bare")
    code = F.when(script | F.col("lang").isin("Java", "C", "C++"), F.regexp_replace(code, body, " ")).otherwise(code)
    code = F.when(script, F.regexp_replace(code, typed, " ")).when(F.col("lang") == "Go", F.regexp_replace(code, result, " ")).otherwise(code)
    code = F.regexp_replace(code, named, " ")
    x = lines(stripped(files).withColumn("bare", code), "bare").where(~F.col("config")).select("file", F.col("n").alias("line"), F.explode(_all(r"([A-Za-z_$][\w$]*)\s*\(")).alias("callee"))
    return x.where((F.length("callee") > 1) & ~F.lower("callee").isin(*fixed.CALL_WARDS) & ~F.col("callee").isin(*KEYWORDS))


def literals(files: DataFrame) -> DataFrame:
    """file, line, text: quoted strings of 2 to 200 characters; in configuration files bare paths and names too."""
    quoted = F.concat(_all(r'"([^"\n]{2,200})"'), _all(r"'([^'\n]{2,200})'"))
    template = _all(r"`([^`\n]{2,200})`")
    bare = F.filter(_all(fixed.CONFIG_BARE), lambda t: t.rlike(fixed.PATH_TOKEN) | t.rlike(fixed.ENV_TOKEN))
    own = F.when(F.col("lang").isin("Go", "Rust"), F.concat(_all(r'"([^"\n]{2,200})"'), template)).otherwise(F.concat(quoted, template))
    return lines(stripped(files), "code").select("file", F.col("n").alias("line"), F.explode(F.when(F.col("config"), F.concat(quoted, bare)).otherwise(own)).alias("text")).distinct()


def route_pattern(pattern: str) -> str:
    """A rule's pattern as a regular expression for a text with marks after opening parentheses, or, where the pattern has
    none, at the start of lines. Its groups: m (method), n (line), v (verb, may be empty), p (path)."""
    node = r"[rbfu]{0,3}(?:\"[^\"\n]*+\"|'[^'\n]*+'|`[^`\n]*+`)"
    name = r"(?<m>[A-Za-z_]\w*)"
    line = _MARK.replace("(", "(?<n>")
    decorator = pattern.startswith("@")
    body = pattern.removeprefix("@")
    recv = body.startswith("$R.")
    body = body.removeprefix("$R.")
    head, _, args = body.partition("(") if "(" in body else body.partition(" ")
    lead = "@" if decorator else ""
    lead += r"(?:[\w$]+\.)+" if decorator and recv else r"\." if recv else "" if decorator else r"(?<![\w.$@])"
    method = name if head == "$M" else f"(?<m>{head})"
    verb = r"[\"'](?<v>[A-Za-z]+)[\"']\s*,\s*" if "$V" in args else "(?<v>)"
    path = f"(?<p>{node})" if '"$P"' not in args and "'$P'" not in args else r"(?<p>\"[^\"\n]*+\")" if '"$P"' in args else r"(?<p>'[^'\n]*+')"
    if "(" not in body:
        return rf"(?m)^{line}[ \t]*+{method}[ \t]+{verb}{path}[ \t]*+(?:,|$)"
    tail = r"\s*\)\s*\{" if "{" in args else r"\s*[,)]"
    return rf"{lead}{method}\({line}\s*{verb}{path}{tail}"


def _groups(regex: str) -> dict[str, int]:
    """Numbers of a regular expression's named groups."""
    return {name: at for at, name in enumerate(re.findall(r"(?<!\\)\((?:\?<([a-z])>|(?!\?))", regex), 1) if name}


def is_route(raw):
    """Whether a call's string can be a route: a path, or a placeholder alone."""
    return raw.rlike(fixed.PATH_TOKEN) | raw.rlike(fixed.PLACEHOLDER_ONLY)


def anchors(files: DataFrame, rules=ANCHOR_RULES, implicit: bool = False) -> DataFrame:
    """id, kind, file, line, implicit: the routes that calls name. A class-level prefix is the first in its file."""
    pack = []
    for _, langs, pattern, methods, prefix, more in rules:
        rx = route_pattern(pattern)
        px = rf"@{prefix[1 : prefix.index('(')]}\({_MARK}\s*([\"'][^\"'\n]*[\"'])" if prefix else None
        pack += [(lang, rx, *(_groups(rx)[g] for g in "mnvp"), px, methods, more) for lang in langs]
    # a rules file is short, and so is this table
    known = F.broadcast(files.sparkSession.createDataFrame(pack, "lang string, rx string, gm int, gn int, gv int, gp int, px string, methods string, more string"))
    x = stripped(files).select("file", "lang", marked("code", r"\(").alias("calls"), marked("code", "^").alias("starts")).join(known, "lang")
    x = x.withColumn("before", F.coalesce(unquote(F.regexp_replace(F.expr("regexp_extract(calls, px, 2)"), _MARK, "")), F.lit("")))
    # each step is an array of its own, so that no expression is repeated in the next one
    group = lambda h, g: F.call_function("regexp_extract", h, F.col("rx"), F.col(g))
    steps = F.expr("regexp_extract_all(if(startswith(rx, '(?m)'), starts, calls), rx, 0)")
    steps = F.transform(steps, lambda h: F.struct(group(h, "gm").alias("m"), group(h, "gn").cast("int").alias("n"), group(h, "gv").alias("v"), unquote(F.regexp_replace(group(h, "gp"), _MARK, "")).alias("p")))
    steps = F.filter(steps, lambda h: F.rlike(h["m"], F.col("methods")))
    kept = lambda h, raw: F.struct(h["m"].alias("m"), h["n"].alias("n"), h["v"].alias("v"), raw.alias("p"))
    steps = F.transform(steps, lambda h: kept(h, F.when(F.col("before") != "", joined_route(F.col("before"), h["p"])).otherwise(h["p"])))
    steps = F.transform(steps, lambda h: kept(h, F.when(F.col("more") == "mount", F.concat(F.lit("/"), F.regexp_replace(h["p"], "^/+", ""))).otherwise(h["p"])))
    steps = F.transform(steps, lambda h: F.struct(h["m"].alias("m"), h["n"].alias("n"), h["v"].alias("v"), *(c.alias(name) for c, name in zip(verb_in_path(h["p"]), ("in_path", "raw"), strict=True))))
    hit = x.select("file", "more", F.explode(steps).alias("h")).select("file", "more", "h.*")
    hit = hit.where(is_route(F.col("raw")) & ((F.col("more") != "verb") | F.col("v").rlike(fixed.HTTP_VERB)))
    verb = F.when(F.col("more") == "verb", F.upper("v")).otherwise(F.coalesce("in_path", verb_of(F.col("m"))))
    return hit.select(F.concat_ws(" ", verb, normal_literal(F.col("raw"), F.lit("path"))).alias("id"), F.lit("route").alias("kind"), "file", F.col("n").alias("line"), F.lit(implicit).alias("implicit")).distinct()


def file_routes(files: DataFrame, rules=fixed.FILE_ROUTES) -> DataFrame:
    """id, kind, file, line (0): routes that files' paths name; verbs from exported handlers or the name's suffix."""
    found = []
    suffix = r"(?i)\.(get|post|put|delete|patch|head|options)$"
    for _, pattern, verbs, prefix, kind in rules:
        x = files.where(F.col("file").rlike(pattern)).select("file", "text", F.regexp_extract("file", pattern, 1).alias("stem"))
        said = F.upper(F.regexp_extract("stem", suffix, 1))
        path = F.concat(F.lit(prefix), file_route_path(F.regexp_replace("stem", suffix, "")))
        each = F.array_distinct(_all(fixed.EXPORTED_VERB, 1, "text")) if verbs == "exports" else F.filter(F.array(said), lambda v: v != "")
        each = F.when(F.size(F.coalesce(each, F.array().cast("array<string>"))) > 0, each).otherwise(F.array(F.lit("ANY")))
        found.append(x.select(F.explode(each).alias("verb"), normal_literal(path, F.lit("path")).alias("path"), F.lit(kind).alias("kind"), "file").select(F.concat_ws(" ", "verb", "path").alias("id"), "kind", "file", F.lit(0).alias("line")))
    return reduce(DataFrame.unionByName, found).distinct()
