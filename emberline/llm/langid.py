"""Language identification by Bayesian evidence fusion.

log P(language | item) is the sum of
 - the text: byte three-grams of its letters under one multinomial model per language, tempered by TEMPER,
   since neighbouring grams aren't independent;
 - the declared language (markup or metadata): P(declared | language), a table counted over all items;
 - the address suffix: P(suffix | language), counted over all items;
 - the host: P(language | host), smoothed towards its domain, that towards all items (KAPPA rows each).
The tables are grouped aggregations over every item, labelled by text alone. What belongs to hosts grows with
the data and is joined by host, never broadcast; the text models are fitted on about LANGUAGE_ROWS rows of each
declared language, however rare it is beside the others.

An item is rejected if its posterior is below ACCEPT_AT or if its text fits no language: its log-likelihood a gram
is then far below what texts of each language have, however few languages there are. Such items have language
"und" and aren't counted in the tables; texts of under SHORT grams are left to the other evidence.

Defined cases: an item without letters (null and empty texts too) has language "und" and is rejected; missing
declared languages, suffixes and hosts are no evidence; without any declared language to learn from all items
are "und"; of equally likely languages the first in the alphabet wins; texts of any length are read whole; repeated rows are
decided each; columns beyond those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, thrifty

#: About so many rows of each declared language are learned from, all of a rarer one.
LANGUAGE_ROWS = 1_000
GRAMS = 1 << 16
#: Of each language's model, this share is spread over all grams: what a model hasn't seen costs the same in each.
SPREAD = 0.02
#: Gram tables of so many languages are held by a task, matrices of so many numbers are gathered at once.
HELD, GATHERED = 64, 1 << 22
TEMPER = 0.3
KAPPA = 20.0
#: Rejected below this posterior probability.
ACCEPT_AT = 0.4
#: A text of SHORT grams or more fits a language whose own texts' mean log-likelihood a gram it misses by at most DROP, and SLACK standard errors.
SHORT, DROP, SLACK = 20, 2.0, 6.0
CHUNK = 1 << 20
#: A host with more than one in HOT_SHARE of all rows is hot: its rows are dealt to SALTS tasks.
HOT_SHARE, SALTS = 1_000, 64

_fold = np.full(256, 32, np.uint8)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Gram numbers of the letters in UTF-8 text, in pieces of bounded size; what isn't a letter separates words, white-space
    runs are one separator. The last bytes of a stretch are kept for the next one, so stretches change nothing."""
    kept, seen, at = np.zeros(0, np.uint8), False, 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        end += end < len(data) and data[end - 1] == 0xC3  # a lead byte stays with the next one
        b = _fold[np.frombuffer(data, np.uint8, end - at, at)]
        if len(b) > 1:  # capital letters of the Latin-1 block
            up = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
            b[1:][up] += 0x20
        x = np.concatenate([kept, b[~((b == 32) & np.r_[len(kept) > 0 and kept[-1] == 32, b[:-1] == 32])]])
        if len(x) >= 3:
            seen = True
            yield _gram_numbers(x)
            x = x[-2:]
        kept, at = x, end
    if not seen and (kept != 32).any():
        x = np.r_[kept, np.full(3 - len(kept), 32, np.uint8)]
        yield _gram_numbers(x)[(x[1:-1] != 32) | (x[:-2] != 32)]


def _gram_numbers(x: np.ndarray) -> np.ndarray:
    w = x.astype(np.uint32)
    return ((w[:-2] * 0x9E37 + w[1:-1]) * 0x85EB + w[2:]) * 0x9E3779B1 >> 16 & (GRAMS - 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in by and len(by) >= HELD:
                yield from _flushed(by)
                by.clear()
            held = by.setdefault(lang, np.zeros(GRAMS, np.int64))
            for g in grams(data):
                held += np.bincount(g, minlength=GRAMS)
    yield from _flushed(by)


def _flushed(by: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, n in by.items():
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])


def fit(items: DataFrame, rows: int = LANGUAGE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their gram weights (GRAMS x languages, float32), and what a fitting text has to reach (2 x languages: log-likelihood
    a gram, and the part of it that goes with one over the root of its grams), from about `rows` items of each declared language.
    items: id, text (binary), declared."""
    told = items.where("declared is not null and id is not null").groupBy("id").agg(F.min("declared").alias("lang"))
    sizes = told.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "s_lang")
    # sizes has a row for each language, few about `rows` short rows for each: they may be broadcast
    few = told.join(F.broadcast(sizes), F.col("lang") == F.col("s_lang")).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("n") < F.lit(rows << 30)).select(F.col("id").alias("f_id"), "lang")
    counted = items.join(F.broadcast(few), items["id"] == few["f_id"]).select("lang", "text").mapInArrow(thrifty(_count), "lang string, gram int, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    # at most GRAMS rows for each language
    tag = pc.dictionary_encode(got["lang"].combine_chunks())
    of, gram, count = tag.indices.to_numpy(), got["gram"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(len(tag.dictionary) + 1))
    names = tag.dictionary.to_pylist()
    learned = dict(few.groupBy("lang").count().collect())
    langs, columns, least = sorted(names), [], []
    for lang in langs:
        own = order[ends[k := names.index(lang)] : ends[k + 1]]
        n = np.zeros(GRAMS)
        n[gram[own]] = count[own]
        columns.append(np.log((1 - SPREAD) * n / n.sum() + SPREAD / GRAMS).astype(np.float32))
        # each gram's log-likelihood by all others; few rows say little of what else the language has
        others = np.log((1 - SPREAD) * np.maximum(n - 1, 0) / max(n.sum() - 1, 1) + SPREAD / GRAMS)
        mean = (n * others).sum() / n.sum()
        slack = SLACK * max(1.0, np.sqrt((n * (others - mean) ** 2).sum() / n.sum()))
        least.append((mean - DROP - slack / np.sqrt(learned[lang]), -slack))
    return (langs, np.stack(columns, 1), np.array(least).T) if langs else (langs, np.zeros((GRAMS, 0), np.float32), np.zeros((2, 0)))


def _text_scores(items: DataFrame, langs: list[str], weights: np.ndarray, least: np.ndarray) -> DataFrame:
    """items without text, with grams (long), fits (whether the text may be of any of the languages) and text_ll (array of double by language)."""
    shared = items.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in items.columns if c != "text"]
    at, k = items.columns.index("text"), len(langs)
    step = max(1024, GATHERED // max(k, 1))

    def run(batches):
        w = shared.value
        for batch in batches:
            lls, n = np.zeros((batch.num_rows, k)), np.zeros(batch.num_rows, np.int64)
            for r, data in enumerate(batch.column(at).to_pylist()):
                for g in grams(data):
                    n[r] += len(g)
                    for at_gram in range(0, len(g), step):
                        lls[r] += w[g[at_gram : at_gram + step]].sum(0, dtype=np.float64)
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, k * batch.num_rows + 1, k or 1, dtype=np.int32) if k else np.zeros(batch.num_rows + 1, np.int32)), pa.array(lls.ravel()))
            m = np.maximum(n, 1)[:, None]
            fits = (n < SHORT) | (lls / m >= least[0] + least[1] / np.sqrt(m)).any(1)
            yield pa.record_batch([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(n), pa.array(fits), ll], names=[*names, "grams", "fits", "text_ll"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema if f.name != "text")
    return items.mapInArrow(thrifty(run), schema + ", grams long, fits boolean, text_ll array<double>")


def identify(items: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None = None, accept_at: float = ACCEPT_AT, carry: tuple[str, ...] = ()) -> DataFrame:
    """items: id (long), text (binary, not null), declared, suffix, domain, host (strings, may be null).
    Returns id, lang, confidence, text_lang (by text alone), kept and the columns of `carry` for every row."""
    langs, weights, least = model or fit(items)
    k = len(langs)
    if not k:
        return items.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.lit(False).alias("kept"), *carry)
    scored = cut(_text_scores(items, langs, weights, least), "langid")
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    voted = scored.withColumn("vote", F.when((F.col("grams") > 0) & F.col("fits"), best(F.col("text_ll"))))
    votes = voted.where("vote is not null")
    counts = lambda: [F.sum((F.col("vote") == j + 1).cast("double")).alias(f"n{j}") for j in range(k)]
    arr = lambda: F.array(*(F.coalesce(F.col(f"n{j}"), F.lit(0.0)) for j in range(k)))

    # few rows, as many as languages: these go through the driver
    total = np.array([x or 0.0 for x in votes.agg(*counts()).first()], float)
    prior = (total + 1) / (total.sum() + k)
    known = F.when(F.col("declared").isin(*langs), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    told = {r[0]: np.array(r[1:], float) for r in votes.select(known.alias("d"), "vote").where("d is not null").groupBy("d").agg(*counts()).collect()}
    declared_ll = {d: np.log((n + 0.5) / (total + 0.5 * (k + 1))) for d, n in told.items()}
    flat = F.array(*(F.lit(0.0) for _ in range(k)))
    # a row for each language and one for all others
    tags = F.broadcast(items.sparkSession.createDataFrame([(d, v.tolist()) for d, v in declared_ll.items()], "d_tag string, d_ll array<double>"))
    declared = F.coalesce("d_ll", flat)

    # what belongs to hosts: tables by host, as large as there are hosts
    smooth = lambda own, above: F.transform(F.arrays_zip(own.alias("o"), above.alias("u")), lambda z: (z["o"] + KAPPA * z["u"]) / (F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + KAPPA))
    hosts = voted.where("host is not null").groupBy("host", "domain", "suffix").agg(F.count("*").alias("rows"), *counts()).select("host", "domain", "suffix", "rows", arr().alias("h"))
    hosts = cut(hosts, "hosts")
    add = lambda: F.array(*(F.sum(F.element_at("h", j + 1)) for j in range(k)))
    # hosts without a dot have one domain together, which needs no join
    dotless = F.array(*(F.lit(float(x)) for x in hosts.where("domain is null").agg(add()).first()[0] if x is not None))
    domains = hosts.where("domain is not null").groupBy("domain").agg(add().alias("d")).select(F.col("domain").alias("d_domain"), "d")
    suffixes = hosts.where("suffix is not null").groupBy("suffix").agg(add().alias("s")).select(F.col("suffix").alias("s_suffix"), "s")
    above = F.array(*(F.lit(float(x)) for x in prior))
    totals = F.array(*(F.lit(float(x)) for x in total))
    suffix_ll = F.transform(F.arrays_zip(F.col("s").alias("o"), totals.alias("u")), lambda z: F.log((z["o"] + 0.5) / (z["u"] + 1.0)))
    by_host = (
        hosts.join(domains, hosts["domain"] == domains["d_domain"], "left")
        .withColumn("d", F.when(F.col("domain").isNull(), dotless).otherwise(F.col("d")))
        .join(suffixes, hosts["suffix"] == suffixes["s_suffix"], "left")
        .groupBy("host")
        .agg(F.max_by(smooth(F.col("h"), smooth(F.col("d"), above)), F.coalesce("domain", F.lit(""))).alias("p"), F.max_by(F.coalesce(suffix_ll, flat), F.coalesce("domain", F.lit(""))).alias("s_ll"))
        .select(F.col("host").alias("h_host"), "p", "s_ll")
    )
    # a host may hold a third of all rows: a hot one's rows go to SALTS tasks, each with a copy of the host's own row.
    # Fewer than HOT_SHARE hosts are hot; their names go through the driver
    held = hosts.agg(F.sum("rows")).first()[0] or 0
    hot = [r[0] for r in hosts.groupBy("host").agg(F.sum("rows").alias("rows")).where(F.col("rows") * HOT_SHARE > held).select("host").collect()]
    is_hot = lambda c: c.isin(hot) if hot else F.lit(False)
    salted = by_host.withColumn("h_salt", F.explode(F.when(is_hot(F.col("h_host")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    voted = voted.withColumn("salt", F.when(is_hot(F.col("host")), F.pmod(F.xxhash64("id", *carry), F.lit(SALTS)).cast("int")).otherwise(0))
    joined = voted.join(salted, (voted["host"] == salted["h_host"]) & (voted["salt"] == salted["h_salt"]), "left").join(tags, known == F.col("d_tag"), "left")
    host_ll = F.transform(F.coalesce("p", above), lambda x: F.log(x))
    zipped = F.arrays_zip(F.col("text_ll").alias("t"), declared.alias("d"), host_ll.alias("h"), F.coalesce("s_ll", flat).alias("s"))
    fused = joined.withColumn("fused", F.transform(zipped, lambda z: TEMPER * z["t"] + z["d"] + z["h"] + z["s"]))
    top = F.array_max("fused")
    sure = 1.0 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(F.greatest(x - top, F.lit(-700.0))))
    name = lambda n: F.element_at(F.array(*map(F.lit, langs)), n)
    heard = F.col("vote").isNotNull()
    return fused.select(
        "id",
        F.when(heard, name(best(F.col("fused")))).otherwise("und").alias("lang"),
        F.when(heard, F.round(sure, 6)).otherwise(0.0).alias("confidence"),
        F.when(heard, name(F.col("vote"))).otherwise("und").alias("text_lang"),
        (heard & (sure >= accept_at)).alias("kept"),
        *carry,
    )


def document_items(docs: DataFrame, *carry: str) -> DataFrame:
    """documents: the declared language is their lang, the host their source, which has no suffix unless it has a dot."""
    host = F.lower(F.nullif(F.col("source").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"), *_address(host), _tag(F.col("lang")).alias("declared"), *carry)


def page_items(pages: DataFrame) -> DataFrame:
    """pages: the declared language is the html element's lang attribute, the host that of the address."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(pages["url"].cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("id"), bare.cast("binary").alias("text"), *_address(host), _tag(declared).alias("declared"))


def _tag(lang):
    return F.nullif(F.lower(F.regexp_extract(lang.cast("string"), "^[A-Za-z]+", 0)), F.lit(""))


def _address(host):
    labels = F.split(host, r"\.")
    dotted = F.instr(host, ".") > 0
    return (
        F.when(dotted, F.element_at(labels, -1)).alias("suffix"),
        F.when(dotted, F.concat_ws(".", F.slice(labels, -2, 2))).alias("domain"),
        host.alias("host"),
    )
