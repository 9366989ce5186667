"""Near-duplicate detection with bottom-k sketches from one hash function.

A document's set is its distinct SHINGLE-word shingles, each a 63-bit hash; its sketch the K smallest of them (the
whole set, if it is smaller). Documents with one set are a class, represented by a row of the smallest doc_id; only
representatives go on, under their row's number, so that a doc_id may belong to rows of different texts.

Inverted lists. A pair of Jaccard similarity 0.75 has LEAST = 24 or more of the K = 64 smallest values of its
union in both sketches but for a chance of 1e-11 (and for certain, if the sets are sketched whole). Values are ranked
rarest first; of any LEAST common values one is among the first |sketch| - LEAST + 1 of either sketch, so only those go
into the lists. Values that one document alone has take the first ranks, so most documents are in no list at all, and a
passage that many documents share matters only to those which it makes up by more than a third.

Candidates. No list emits all its pairs. Every document of a list is compared with the list's leader, what is linked becomes one
component, and lists within one component are done. Lists of up to SMALL documents then compare what is still in
different components. Larger ones take two further leaders; documents whose lists are still open then form groups, and a
group is compared in blocks inside tasks, documents outside its largest component against all others. What passes by
sketches is verified there on full sets, and only links that join components leave a task: no rows stand for
pairs. That work alone grows with the square of a group, of documents that have over a third of their text in
common and are still no near-duplicates of one another.

Each candidate is estimated by the sketch of its union and verified on full sets; sketches that are whole sets decide at
once. Links are exact (on 63-bit hashes); components come from links between different sets only.

Defined cases: null text and text without words has the empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle, other than any full one; a null doc_id is linked with nothing, has a null component and is kept;
rows are linked each by its own text, so rows of one doc_id are together only if their texts are similar: group, the
number of a row of the component, tells components apart (null where a row is linked with nothing by definition); texts of any
length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import ROW, cut, numbered, only, text_or_empty, thrifty
from emberline.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
K, LEAST = 64, 24
SMALL = 32
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Exact sizes of intersections come from one matrix product where a pair of blocks has at most so many common values.
DENSE = 32_768
CACHED = 100_000
P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to 64-bit hash, bounded; lives as long as the Python worker."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED:
            self[word] = h
        return h


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((h ^ h >> np.uint64(31)) >> np.uint64(1)).astype(np.int64)


def shingle_set(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    words = data.lower().split()  # bytes.lower() changes A-Z only, bytes.split() cuts at \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    if n < width:
        h = np.full(1, n, np.uint64)
        for x in w:
            h = h * P + x
        return _mixed(h)
    h = w[: n - width + 1].copy()
    for k in range(1, width):
        h = h * P + w[k : n - width + 1 + k]
    return np.unique(_mixed(h))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x) for x in batch.column(2).to_pylist()]
        marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), _lists([s[:K] for s in sets])], names=["row", "doc_id", "n", "mark", "sketch"])


def _full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), _lists([shingle_set(x) for x in batch.column(1).to_pylist()])], names=["rep", "vals"])


def _entries(reps: DataFrame) -> DataFrame:
    """The inverted lists: v, rep, n, of values that two or more documents have among their prefixes."""
    posted = reps.select("rep", F.explode("sketch").alias("v"))
    shared = posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("v", "d_v")
    # at most K values a document; those no other document has come first and aren't here
    held = posted.join(shared, posted["v"] == shared["d_v"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    sizes = reps.select(F.col("rep").alias("s_rep"), "n", F.size("sketch").alias("s"))
    ranked = held.join(sizes, held["rep"] == sizes["s_rep"])
    least = F.when(F.col("n") <= K * PERCENT // 100, F.ceil(F.col("n") * PERCENT / 100)).otherwise(LEAST)
    first = F.col("s") - least + 1 - (F.col("s") - F.size("held"))
    return ranked.where(first > 0).select("rep", "n", F.explode(F.slice("held", F.lit(1), first.cast("int"))).alias("x")).select("rep", "n", F.col("x.v").alias("v"))


def _matrix(values: np.ndarray, owner: np.ndarray, rows: int, columns: np.ndarray) -> np.ndarray:
    """1 where a row has a column's value."""
    k = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
    ok = columns[k] == values
    x = np.zeros((rows, len(columns)), np.float32)
    x[owner[ok], k[ok]] = 1
    return x


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def _common(left: list[np.ndarray], right: list[np.ndarray], most: int | None = None) -> np.ndarray | None:
    """Sizes of all intersections; None if over `most` values occur on both sides."""
    (lv, lo), (rv, ro) = _flat(left), _flat(right)
    both = np.intersect1d(lv, rv)
    if most is not None and len(both) > most:
        return None
    if not len(both):
        return np.zeros((len(left), len(right)), int)
    return (_matrix(lv, lo, len(left), both) @ _matrix(rv, ro, len(right), both).T).astype(int)


def _compare(t: pa.Table) -> pa.Table:
    """Links (u, v) between two blocks of a group, as many as join components."""
    links: list[tuple[int, int]] = []
    out = lambda: pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})
    if t.num_rows < 2:
        return out()
    rep, n, comp, own = (t[k].to_numpy() for k in ("rep", "n", "comp", "own"))
    major, kind, i, j = t["major"].to_numpy(), t["kind"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
    left, right = np.flatnonzero(major if kind == "d" else own == i), np.flatnonzero(~major if kind == "d" else own == j)
    if not len(left) or not len(right):
        return out()
    column = t["vals"].combine_chunks()
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    sets = [values[ends[r] : ends[r + 1]] for r in range(t.num_rows)]
    few = _common([sets[r][:K] for r in left], [sets[r][:K] for r in right])
    a, b = n[left][:, None], n[right][None, :]
    small, large = np.minimum(a, b), np.maximum(a, b)
    need = np.where(large <= K, -(-PERCENT * large // 100), np.minimum(LEAST, -(-PERCENT * small // 100)))
    p, q = np.nonzero((few >= need) & (100 * small >= PERCENT * large) & (comp[left][:, None] != comp[right][None, :]))
    order = np.argsort(-few[p, q], kind="stable")
    p, q = p[order], q[order]
    if len(p) > 2000:
        lp, rq = np.unique(p), np.unique(q)
        exact = _common([sets[left[r]] for r in lp], [sets[right[r]] for r in rq], DENSE)
        if exact is not None:
            both = exact[np.searchsorted(lp, p), np.searchsorted(rq, q)]
            ok = 100 * both >= PERCENT * (n[left[p]] + n[right[q]] - both)
            p, q = p[ok], q[ok]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    for x, y in zip(left[p].tolist(), right[q].tolist(), strict=True):
        cx, cy = find(int(comp[x])), find(int(comp[y]))
        if cx != cy:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= PERCENT * (n[x] + n[y] - both):
                root[cx] = cy
                links.append((int(rep[x]), int(rep[y])))
    return out()


class _Search:
    """Candidates, verification and components over one set of lists."""

    def __init__(self, texts: DataFrame, reps: DataFrame):
        """texts: row, text; reps: rep (a row), n, sketch."""
        self.texts, self.lists = texts, cut(_entries(reps), "lists")
        self.members = self.lists.select("rep").distinct()
        self.sketches = cut(only(reps.select("rep", "sketch"), "rep", self.members), "sketches")
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.comps: DataFrame | None = None
        self.sets: DataFrame | None = None

    def placed(self) -> DataFrame:
        """List entries with their components, of lists that lie in more than one."""
        e = self.lists
        if self.comps is None:
            e = e.withColumn("comp", F.col("rep"))
        else:
            c = self.comps.toDF("c_node", "c_comp")
            e = e.join(c, e["rep"] == c["c_node"], "left").select("v", "rep", "n", F.coalesce("c_comp", "rep").alias("comp"))
        return e

    def open_lists(self, placed: DataFrame, *more) -> DataFrame:
        return placed.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), *more).where("lo < hi").withColumnRenamed("v", "o_v")

    def star(self, placed: DataFrame, salts: tuple[int, ...], least: int = 0) -> DataFrame:
        """Every document of an open list of over `least` documents with the list's leaders."""
        order = lambda s: F.min(F.struct((F.xxhash64("rep", F.lit(s)) if s else F.col("rep")).alias("h"), "rep", "n", "comp"))
        opened = self.open_lists(placed, F.array(*(order(s) for s in salts)).alias("leaders")).where(F.col("m") > least)
        x = placed.join(opened.select("o_v", "leaders"), placed["v"] == F.col("o_v")).select("rep", "n", "comp", F.explode("leaders").alias("l"))
        return x.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("l.rep").alias("b"), F.col("l.n").alias("bn"), F.col("l.comp").alias("bc"))

    def small(self, placed: DataFrame) -> DataFrame:
        """All pairs of open lists of at most SMALL documents."""
        opened = self.open_lists(placed).where(F.col("m") <= SMALL)
        rows = F.sort_array(F.collect_list(F.struct("rep", "n", "comp")))
        held = placed.join(opened.select("o_v"), placed["v"] == F.col("o_v"), "left_semi").groupBy("v").agg(rows.alias("x"))
        x = held.select(F.posexplode("x").alias("i", "l"), "x").where("i > 0").select("l", F.explode(F.slice("x", F.lit(1), F.col("i"))).alias("r"))
        return x.select(F.col("l.rep").alias("a"), F.col("l.n").alias("an"), F.col("l.comp").alias("ac"), F.col("r.rep").alias("b"), F.col("r.n").alias("bn"), F.col("r.comp").alias("bc"))

    def blocks(self, placed: DataFrame) -> DataFrame:
        """Links of documents that share an open list of over SMALL documents. Such documents form groups (joined by
        those lists), and each group is compared in blocks: documents outside its largest component with those inside,
        and with one another. A task holds two blocks with their full sets; of the links that it finds, those leave it
        that join components."""
        opened = self.open_lists(placed, F.min("rep").alias("leader")).where(F.col("m") > SMALL).select("o_v", "leader")
        held = cut(placed.join(opened, placed["v"] == opened["o_v"]).select("rep", "n", "comp", "leader").distinct(), "hot")
        groups = connected_components(held.where("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v")), "groups")
        x = held.select("rep", "n", "comp").distinct()
        x = x.join(groups.toDF("g_node", "g"), x["rep"] == F.col("g_node")).select("g", "rep", "n", "comp")
        by = x.groupBy("g", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("s")).groupBy("g").agg(F.max(F.struct("k", "comp", "s")).alias("top"), F.sum("k").alias("m"), F.sum("s").alias("s"), F.count("*").alias("comps"))
        number = lambda k, s: F.greatest(F.ceil(k / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
        by = by.where("comps > 1").select(F.col("g").alias("t_g"), F.col("top.comp").alias("top"), number(F.col("top.k"), F.col("top.s")).alias("nd"), number(F.col("m") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("nb"))
        x = x.join(by, x["g"] == by["t_g"]).withColumn("major", F.col("comp") == F.col("top"))
        own = F.pmod(F.xxhash64("rep"), F.when(F.col("major"), F.col("nd")).otherwise(F.col("nb"))).cast("int")
        d, b = F.lit("d"), F.lit("b")
        cell = lambda kind, i, j: F.struct(kind.alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
        numbers = lambda n: F.sequence(F.lit(0), n - 1)
        cells = F.when(F.col("major"), F.transform(numbers(F.col("nb")), lambda j: cell(d, F.col("own"), j))).otherwise(
            F.concat(F.transform(numbers(F.col("nd")), lambda i: cell(d, i, F.col("own"))), F.transform(numbers(F.col("nb")), lambda j: cell(b, F.least(F.col("own"), j), F.greatest(F.col("own"), j))))
        )
        x = x.withColumn("own", own).select("g", "rep", "n", "comp", "own", "major", F.explode(cells).alias("c")).select("g", "rep", "n", "comp", "own", "major", "c.kind", "c.i", "c.j")
        sets = self.full_sets().toDF("s_rep", "vals")
        x = x.join(sets, x["rep"] == sets["s_rep"]).select("g", "kind", "i", "j", "rep", "n", "comp", "own", "major", "vals")
        return x.groupBy("g", "kind", "i", "j").applyInArrow(_compare, "u long, v long")

    def full_sets(self) -> DataFrame:
        """rep and its full set, for every representative in a list; made once, from the representatives' own rows."""
        if self.sets is None:
            self.sets = cut(only(self.texts, "row", self.members).mapInArrow(thrifty(_full), "rep long, vals array<long>"), "sets")
        return self.sets

    def join(self, links: DataFrame) -> None:
        if links.head(1):
            self.links = links if self.links is None else self.links.unionByName(links)
            self.comps = connected_components(self.links)

    def check(self, pairs: DataFrame) -> None:
        """Estimates and verifies pairs in different components; links and components grow by what is confirmed."""
        fit = (F.col("ac") != F.col("bc")) & (100 * F.least("an", "bn") >= PERCENT * F.greatest("an", "bn"))
        turned = F.col("a") > F.col("b")
        pairs = pairs.where(fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("bn")).otherwise(F.col("an")).alias("an"), F.when(turned, F.col("an")).otherwise(F.col("bn")).alias("bn")).distinct()
        if self.tested is not None:
            t = self.tested.toDF("t_a", "t_b")
            pairs = pairs.join(t, (pairs["a"] == t["t_a"]) & (pairs["b"] == t["t_b"]), "left_anti")
        one, two = self.sketches.toDF("ra", "sa"), self.sketches.toDF("rb", "sb")
        x = pairs.join(one, pairs["a"] == one["ra"])
        x = x.join(two, x["b"] == two["rb"])
        common = F.array_intersect("sa", "sb")
        every = F.array_union("sa", "sb")
        whole = (F.col("an") <= K) & (F.col("bn") <= K)
        est = F.size(F.array_intersect(F.slice(F.sort_array(every), 1, K), common))
        x = x.select("a", "b", "an", "bn", F.when(whole, 100 * F.size(common) >= PERCENT * F.size(every)).otherwise(F.when(est >= LEAST, F.lit(None).cast("boolean")).otherwise(False)).alias("linked"))
        seen = cut(x, "candidates")
        links = seen.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        doubtful = seen.where("linked is null")
        if doubtful.head(1):
            links = links.unionByName(self.verified(doubtful))
        links = cut(links, "links")
        self.tested = seen.select("a", "b") if self.tested is None else self.tested.unionByName(seen.select("a", "b"))
        self.join(links)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose full sets are similar."""
        sets = self.full_sets()
        one, two = sets.toDF("ra", "sa"), sets.toDF("rb", "sb")
        x = pairs.select("a", "b", "an", "bn").join(one, F.col("a") == one["ra"])
        x = x.join(two, x["b"] == two["rb"]).withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return x.where(100 * F.col("i") >= PERCENT * (F.col("an") + F.col("bn") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def run(self) -> DataFrame | None:
        """node and component of every representative that is linked."""
        self.check(self.star(self.placed(), (0,)))
        placed = self.placed()
        self.check(self.small(placed).unionByName(self.star(placed, (1, 2), SMALL)))
        placed = self.placed()
        if self.open_lists(placed).where(F.col("m") > SMALL).head(1):
            self.join(cut(self.blocks(placed), "links"))
        return self.comps


def near_duplicates(docs: DataFrame, text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs; also group and the row's number, if docs has it in
    the column `row` (see common.numbered)."""
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs, text).cast("binary").alias("text"), *([F.col(row).alias(ROW)] if row else []))
    items = (items if row else numbered(items)).select(F.col(ROW).alias("row"), "doc_id", "text")
    sketched = cut(items.mapInArrow(thrifty(_sketch), "row long, doc_id long, n long, mark binary, sketch array<long>"), "sketches")
    told = sketched.where("n > 0 and doc_id is not null")
    classes = cut(told.groupBy("mark").agg(F.min(F.struct("doc_id", "row")).alias("f")).select("mark", F.col("f.doc_id").alias("least"), F.col("f.row").alias("rep")), "classes")
    reps = only(told, "row", classes.select("rep")).select(F.col("row").alias("rep"), "n", "sketch")
    comps = _Search(items.select("row", "text"), reps).run()
    if comps is None:
        placed = classes.select("mark", "least", F.col("rep").alias("group"))
    else:
        classes = classes.join(comps, classes["rep"] == comps["node"], "left").select("mark", "least", F.coalesce("component", "rep").alias("group"))
        low = classes.groupBy("group").agg(F.min("least").alias("least")).withColumnRenamed("group", "l_group")
        placed = classes.join(low, classes["group"] == low["l_group"]).select("mark", low["least"], "group")
    placed = placed.withColumnRenamed("mark", "c_mark")
    x = sketched.select("row", "doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("mark")).alias("mark"))
    x = x.join(placed, x["mark"] == placed["c_mark"], "left")
    component = F.coalesce("least", "doc_id")
    return x.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["group", F.col("row").alias(row)] if row else []))
