"""Results depend on these, so they are stated as they must be."""

# Directories and lock files that are never listed, and this engine's own folder.
IGNORED_DIRS = (
    ".git", "node_modules", "dist", "vendor", ".venv", "venv", "target", "coverage", ".next", "build",
    "__pycache__", ".emberline", "deps", "_build", ".tox", "Pods", ".cargo",
)
LOCK_FILES = (
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "pipfile.lock",
    "poetry.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum",
)

# Languages by extension, binary and configuration extensions.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "Tsx", "mts": "TypeScript", "cts": "TypeScript",
    "js": "JavaScript", "jsx": "Tsx", "mjs": "JavaScript", "cjs": "JavaScript",
    "py": "Python", "go": "Go", "rs": "Rust", "ex": "Elixir", "exs": "Elixir", "rb": "Ruby",
    "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++",
    "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "lua": "Lua", "php": "Php", "swift": "Swift",
    "scala": "Scala", "hs": "Haskell", "sh": "Bash",
}
BINARY_EXTENSIONS = ("beam", "pyc", "o", "obj", "so", "a", "d")
CONFIG_EXTENSIONS = ("yaml", "yml", "json", "toml", "env", "tf", "hcl", "md")

# Limits on listing and extraction.
MAX_FILES, MAX_FILE_BYTES, LONG_LINE = 8000, 1 << 20, 4000
GENERATED_NAME = r"(?i)\.(?:min|bundle)\.(?:[cm]?js|[cm]?ts|jsx|tsx|mjs|cjs)$"

# Patterns of literals.
PATH_TOKEN = r"^(?:/[\w.~+\-{}*:$]+/?|/?[\w.~+\-]+(?:/[\w.~+\-{}*:$]+)+/?)$"
ENV_TOKEN = r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"
WORD_TOKEN = r"^[A-Za-z][\w$.\-]{6,63}$"
ORIGIN = r"^(?:https?|wss?)://[^/]+"
PLACEHOLDER = r"^(?::[^/]+|\{[^}/]*\}|\$\{[^}/]*\}|\$[A-Za-z_]\w*|<[^/>]+>|\*+)$"
CONFIG_BARE = r"(?:^|[:=\s])(/[\w.~+\-{}*]+(?:/[\w.~+\-{}*]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)(?=$|[:=\s])"
TEST_FILE = r"(^|/)(test_|conftest)|\.(test|spec)\.[tj]sx?$|_test\.go$"
TEST_SCOPE = r"(?i)(^|/)(tests?|__tests__|fixtures?)(/|$)"

# Weights and gates of shared literals.
LITERAL_BASE = {"path": 1.0, "env": 0.8, "word": 0.55}
MAX_DF, LOOKUP_CAP = 48, 192

# Words that a query's terms leave out.
STOP_WORDS = (
    "a", "an", "and", "are", "do", "does", "find", "for", "happen", "happens", "how",
    "in", "is", "of", "on", "please", "the", "this", "to", "what", "where", "which", "with",
)

# Callees that carry no meaning across files.
CALL_WARDS = (
    "log", "info", "warn", "debug", "trace", "close", "flush", "tostring", "valueof", "tolowercase", "touppercase", "printf", "sprintf", "fprintf", "errorf",
    "fatal", "fatalf", "panic", "panicf", "println", "print",
    "require", "console", "settimeout", "setinterval", "cleartimeout", "clearinterval", "queuemicrotask", "parseint", "parsefloat", "isnan", "isfinite",
    "it", "describe", "test", "expect", "xit", "xdescribe", "beforeeach", "aftereach", "beforeall", "afterall", "jest", "vitest", "vi", "mock", "spyon",
    "str", "int", "float", "bool", "bytes", "bytearray", "list", "dict", "set", "tuple", "frozenset", "super", "isinstance", "issubclass", "getattr", "setattr",
    "hasattr", "delattr", "open", "range", "enumerate", "zip", "sorted", "next", "all", "any", "sum", "abs", "round", "format", "chr", "ord", "hex", "oct",
    "bin", "id", "input", "vars", "dir", "callable", "hash", "object", "property", "staticmethod", "classmethod", "memoryview", "slice", "type", "repr", "len",
    "append", "cap", "clear", "delete", "make", "new", "copy", "complex", "real", "imag", "recover", "min", "max",
    "unwrap", "clone", "into", "from", "collect", "iter", "eprintln", "vec", "assert", "asserteq", "assertne", "dbg",
)

# Graph weights, call gates and relation priorities.
EDGE_WEIGHT = {"contains": 1.0, "imports": 0.3, "tests": 0.6, "inherits": 0.9}
MAX_CANDIDATES, MAX_CHOSEN = 48, 3
RELATION_PRIORITY = {"contains": 0, "imports": 2, "join": 3, "anchors": 4, "tests": 5, "inherits": 6, "invokes": 7}
REASONS = {"invokes": "call dependency", "imports": "import dependency", "tests": "test dependency", "inherits": "inheritance", "join": "shared literal", "anchors": "shared route"}
HISTORY_REASON, NO_REASON = "co-change history", "graph path"

# Co-change.
MAX_COMMITS, MAX_FILES_PER_COMMIT, MIN_SHARED, MAX_PARTNERS, RECENCY_DAYS = 400, 24, 2, 16, 30.0

# Tiers and caps of a reveal.
HOT, WARM, LIT_SHARE, HEAT_EPS, MAX_LIT, MAX_WARM_PER_FILE = 0.3, 0.02, 0.002, 1e-9, 400, 4
MAX_SEEDS, MAX_HUBS, MAX_SKETCH_SEEDS, MAX_WARMED, SUGGEST_AT = 16, 24, 64, 2000, 0.34

# Drift.
CHANNEL_WEIGHT = {
    "call dependency": 1.0, "import dependency": 1.0, "test dependency": 1.0, "inheritance": 1.0,
    "shared route": 1.0, "co-change history": 0.5, "shared literal": 0.35, "graph path": 0.5,
}
UNKNOWN_CHANNEL, HALF_LIFE_HOURS, MEMORY_CAP, REARM_SHARE, STEER_AT = 0.5, 48.0, 4096, 0.5, 0.15
JOURNAL_CAP, JOURNAL_DAYS = 256, 7

# Method names that mount instead of naming a verb, HTTP verbs.
METHOD_ALIASES = {
    "PATH": "ANY", "RE_PATH": "ANY", "URL": "ANY", "MATCH": "ANY", "ROOT": "ANY", "REQUESTMAPPING": "ANY", "RESOURCES": "ANY", "FORWARD": "ANY",
    "FETCH": "GET", "REDIRECT": "GET", "RESPONDREDIRECT": "GET", "REDIRECT_TO": "GET",
}
HTTP_VERB = r"(?i)^(?:get|post|put|delete|patch|head|options)$"
VERB_IN_PATH = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S*)$"
PLACEHOLDER_ONLY = r"^(:[A-Za-z_]\w*|\{[A-Za-z_]\w*\}|\[[A-Za-z_]\w*\])$"

# Routes that are a file's path: id, pattern (group 1 is the stem), where verbs come from, prefix, kind.
FILE_ROUTES = (
    ("next-app-route", r"(?:^|/)app/(.+)/route\.(?:ts|tsx|js|jsx|mjs)$", "exports", "", "route"),
    ("next-app-page", r"(?:^|/)app/(?:(.+)/)?page\.(?:tsx|jsx|mdx)$", "suffix", "", "page"),
    ("next-pages-api", r"(?:^|/)pages/api/(.+)\.(?:ts|tsx|js|jsx)$", "suffix", "/api", "route"),
    ("sveltekit-server", r"(?:^|/)src/routes/(?:(.+)/)?\+server\.(?:ts|js)$", "exports", "", "route"),
    ("sveltekit-page", r"(?:^|/)src/routes/(?:(.+)/)?\+page\.(?:svelte|md)$", "suffix", "", "page"),
    ("nuxt-server-api", r"(?:^|/)server/api/(.+)\.(?:ts|js|mjs)$", "suffix", "/api", "route"),
    ("astro-endpoint", r"(?:^|/)src/pages/(.+)\.(?:ts|js|mjs)$", "exports", "", "route"),
)
EXPORTED_VERB = r"\bexport\s+(?:(?:async\s+)?function\s+|const\s+)(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"

# Callees that discovery leaves out, its floors.
DISCOVERY_DENIED = (
    "join", "resolve", "dirname", "basename", "expand_path", "readFile", "readFileSync", "existsSync", "open", "load", "loads",
    "import", "require", "startsWith", "endsWith", "contains", "includes", "equals", "equalsIgnoreCase",
    "matches", "matchesPattern", "useParams", "matchPath",
)
MIN_SITES, MIN_SIG_FILES, MIN_POSTERIOR = 4, 2, 0.55
