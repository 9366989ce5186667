"""Secret scans with multipart credential linking.

Base spans (assign, access, hex) are fixed patterns. The linking method adds spans of weak candidates,
which say nothing alone: an identifier (access key id, client id, user name), a secret (a mixed token, a
short pass phrase) and an endpoint (address with scheme, host with port). They are joined by scope, a block of
text between blank lines: a secret and an identifier in one scope are reported, so are a secret and an
endpoint, and whatever else of the scope complements a secret. Parts that overlap don't complement each other, and a secret inside
an address is no complement of addresses. Only within one line of running text are parts kept apart: where over WINDOW code points
lie between neighbours, be they parts or settings (name = value). The join runs over each document's sorted intervals inside the scan,
since no scope crosses documents: nothing is shuffled, and no pair is emitted.

Defined cases: null text is the empty text and has no spans; repeated rows are scanned each; whole texts
of any length are scanned; spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_or_empty, thrifty

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "identifier", "secret", "endpoint")
RANK = {k: n for n, k in enumerate(KINDS)}
WINDOW = 200
MASK = "[redacted]"

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

IDENTIFIER = re.compile(r"""(?ai)(?:client_?id|access_?key(?:_?id)?|account|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""")
OWN_ID = re.compile(r"A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{12,}")
ID_WORDS = ("client", "access", "account", "user", "login")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PHRASE = re.compile(r"""(?ai)(?:pass(?:word|wd|phrase)?|pwd|pin|key)["']?\x20*[:=]\x20*["']?[^\s"']{3,}""")
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+]{1,12}://[^\s\"'<>]{3,}|\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}:\d{2,5}\b")
SETTING = re.compile(r"""(?a)[A-Za-z][\w.-]*["']?\x20*[:=]\x20*["']?[^\s"']""")
SCOPE_END = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _mixed(token: str) -> bool:
    """A token that looks drawn at random: digits beside letters of either case, and much of its entropy."""
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * log2(k / n) for k in Counter(token).values()) >= 3.0


class _Parts:
    """The spans of one kind, by scope, by line, and by stretch of a line: the least end and greatest start of each."""

    def __init__(self, spans: Iterable[tuple[int, int]], places) -> None:
        self.spans = sorted(set(spans))
        self.at: dict[tuple, tuple[int, int]] = {}
        self.lines: dict[int, tuple[int, int]] = {}
        for s, e in self.spans:
            scope, line, _ = place = places((s, e))
            lo, hi = self.at.get(place, (e, s))
            self.at[place] = min(lo, e), max(hi, s)
            first, last = self.lines.get(scope, (line, line))
            self.lines[scope] = min(first, line), max(last, line)

    def beside(self, span: tuple[int, int], place: tuple[int, int, int]) -> bool:
        """Whether one of these is on another line of the span's scope, or in its stretch of the line and not over it."""
        scope, line, _ = place
        if scope in self.lines and self.lines[scope] != (line, line):
            return True
        lo, hi = self.at.get(place, (span[1], span[0]))
        return lo <= span[0] or hi >= span[1]


def linked_spans(text: str) -> list[tuple[int, int, str]]:
    """Identifiers, secrets and endpoints that complement each other within a scope."""
    low = text.lower()
    has_words = any(w in low for w in ID_WORDS)
    ids = [m.span() for m in OWN_ID.finditer(text)] if re.search("AKIA|ASIA|AROA|AIDA", text) else []
    ids += [m.span() for m in IDENTIFIER.finditer(text)] if has_words else []
    points = sorted(m.span() for m in ENDPOINT.finditer(text)) if ":" in text else []
    if not ids and not points:
        return []
    ends = [m.end() for m in SCOPE_END.finditer(text)]
    scope = lambda span: bisect_right(ends, span[0])
    held = {scope(x) for x in ids + points}
    own = lambda found: [x for x in found if scope(x) in held]
    secrets = own(m.span() for m in TOKEN.finditer(text) if _mixed(m[0]) and not OWN_ID.fullmatch(m[0])) + own(m.span() for m in PHRASE.finditer(text))
    if not secrets:
        return []
    breaks = [m.start() for m in re.finditer("\n", text)]
    gaps, until = [], 0
    for s, e in sorted({*ids, *secrets, *points, *(m.span() for m in SETTING.finditer(text))}):
        if s - until > WINDOW:
            gaps.append(s)
        until = max(until, e)
    places = lambda span: (scope(span), bisect_right(breaks, span[0]), bisect_right(gaps, span[0]))
    inside = lambda span: (k := bisect_right(points, (span[0], len(text)))) > 0 and points[k - 1][1] > span[0]

    by_id, by_point = _Parts(ids, places), _Parts(points, places)
    by_secret = _Parts(secrets, places)
    free = _Parts((x for x in by_secret.spans if not inside(x)), places)
    named = [x for x in by_id.spans if by_secret.beside(x, places(x))]
    told = [x for x in by_secret.spans if by_id.beside(x, p := places(x)) or (not inside(x) and by_point.beside(x, p))]
    pairs = _Parts((x for x in [*named, *told] if not inside(x)), places)
    reached = [x for x in by_point.spans if free.beside(x, p := places(x)) or pairs.beside(x, p)]
    return [(*x, k) for k, found in (("identifier", named), ("secret", told), ("endpoint", reached)) for x in found]


def scan(text: str) -> tuple[list, list]:
    """Base spans and all spans of a text, each (start, end, kind) by start, then kind as listed."""
    order = lambda x: (x[0], RANK[x[2]], x[1])
    base = base_spans(text)
    return sorted(base, key=order), sorted(base + linked_spans(text), key=order)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with the union of the spans replaced by MASK; touching spans get one mask each, overlapping ones one together."""
    out, at, until = [], 0, -1
    for s, e, _ in spans:
        if s < until:
            if e > until:
                at = until = e
            continue
        out += [text[at:s], MASK]
        at = until = e
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base, every = scan(text)
            n = Counter(k for _, _, k in base)
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: counts of base spans, their digest, and all spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text")).mapInArrow(thrifty(_scan_batches), SCHEMA)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every span found replaced by MASK and the length column, if there is one, set anew.
    Null texts stay null; rows without spans stay as they are."""
    at = docs.columns.index(text)
    lengths = docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t and masked(t, scan(t)[1]) for t in texts]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if lengths is not None:
                old = cols[lengths].to_pylist()
                cols[lengths] = pa.array([o if n is None or n == t else len(n) for o, n, t in zip(old, new, texts, strict=True)], batch.schema.field(lengths).type)
            yield pa.record_batch(cols, schema=batch.schema)

    return docs.mapInArrow(thrifty(run), docs.schema)
