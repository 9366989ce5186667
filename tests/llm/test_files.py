import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from emberline.llm import packing, tokenfile, warc, wordbpe
from emberline.llm.common import shared_path
from emberline.llm.queries import OP5_SQL, op5_warc_archives, op9_token_files, op10_best_fit_packing

SF = "/root/testdata/sf0.001"


# archives ---------------------------------------------------------------------------------------------------------
def test_archives_against_sql(spark, check_rows):
    check_rows(op5_warc_archives(spark, SF), OP5_SQL)


def archive(payloads, dictionary=b"", **options):
    packer = zstandard.ZstdCompressor(level=3, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}), **options)
    import hashlib

    return warc.opening(dictionary) + b"".join(packer.compress(warc.make_record(k, f"http://x/{k}", p, hashlib.sha256(p).hexdigest())) for k, p in enumerate(payloads))


def test_reader_takes_dictionaries_and_frames_of_all_kinds():
    rng = random.Random(1)
    payloads = [b"", b"a" * 100_000, bytes(rng.randrange(256) for _ in range(300_000)), b"<html>" * 50]
    known = warc.train_dictionary([f"<html><p>page {k} of many pages, with words {k * 7}</p></html>".encode() * 20 for k in range(200)])
    for data in (archive(payloads), archive(payloads, known), archive(payloads, b"some raw content, no trained dictionary"), archive(payloads, known, write_checksum=True), archive(payloads, write_content_size=True)):
        got = list(warc.read_archive(data))
        assert [r.payload for r in got] == payloads
        assert [r.headers["x-page-id"] for r in got] == ["0", "1", "2", "3"]


def test_frame_ends_are_those_of_the_library():
    data = archive([b"x" * k for k in range(0, 4000, 97)])
    at = n = 0
    while at < len(data):
        end = warc.frame_end(memoryview(data), at)
        assert zstandard.ZstdDecompressor().decompress(data[at:end])
        at, n = end, n + 1
    assert n == len(range(0, 4000, 97))


def repacked(record):
    return zstandard.ZstdCompressor().compress(record)


def test_broken_archives_are_refused():
    import hashlib

    p = b"payload" * 30
    good = warc.make_record(1, "u", p, hashlib.sha256(p).hexdigest())
    assert len(list(warc.read_archive(repacked(good)))) == 1
    bad = [
        archive([p])[:-3],
        b"junk" + archive([p]),
        struct.pack("<II", warc.SKIPPABLE, 10**6) + b"abc",
        repacked(good.replace(b"WARC/1.1", b"WARC/9.9")),
        repacked(good.replace(b"WARC-Record-ID", b"X-Record-ID")),
        repacked(good.replace(b"Content-Length: ", b"Content-Length: 1")),
        repacked(good.replace(b"payloadpayload", b"payloadPayload", 1)),
        repacked(good[:-2]),
        repacked(good + b"x"),
    ]
    for data in bad:
        with pytest.raises(warc.BadRecord):
            list(warc.read_archive(data))


def test_archives_roll(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "u", f"{k} " + "".join(random.Random(k).choices("abcdef", k=3000))) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    old = warc.write_archives.__globals__["ROLL_BYTES"]
    assert old == 16 << 20
    manifest = warc.write_archives(pages, shared_path(spark, "warc-test"))
    assert manifest.count() >= 1 and sorted(r.page_id for r in warc.read_archives(manifest).collect()) == list(range(60))


# token files ------------------------------------------------------------------------------------------------------
def test_cached_words_change_nothing(spark):
    code, rng = wordbpe.coder(wordbpe.default_path()), random.Random(3)
    assert code.words
    letters = list("abC Z'’,.!?\n\t éß日本🙂19_-—“”") + ["́", "　", "İ", "K", "ſ", "<|", "|>", "it's", "<|endoftext|>", "<|ENDOFTEXT|>"]
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randrange(0, 25)))
        assert np.frombuffer(code.encode(text.encode()), code.kind).tolist() == [*code.library.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_token_files_hold_what_the_library_says(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    code, at = wordbpe.coder(wordbpe.default_path()), 0
    got = sorted(op9_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    for r, (i, text) in zip(got, docs, strict=True):
        ids = [*code.library.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_few_tasks_write_many_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_CHARS", 2000)
    monkeypatch.setattr(tokenfile, "PARTITIONS", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = shared_path(spark, "tokens-test")
    manifest = tokenfile.write_tokens(docs, folder)
    rows = manifest.collect()
    assert len({r.shard for r in rows}) <= 2 and len(rows) > 4 and sum(r.docs for r in rows) == docs.count()
    got = sorted(tokenfile.read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_shards_are_ordered_and_have_bases(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_CHARS", 2000)
    docs = spark.createDataFrame([(k, f"word{k} " * (k % 40)) for k in range(300)], "doc_id long, text string").repartition(6)
    folder = shared_path(spark, "tokens-test")
    manifest = tokenfile.write_tokens(docs, folder)
    assert manifest.count() > 3
    got = sorted(tokenfile.read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(300))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    row = manifest.orderBy("shard", "nth").first()
    shard = tokenfile.Shard(f"{folder}/{row.shard:06d}-{row.nth:05d}-{row.attempt}")
    assert shard.tokens.dtype == np.dtype("<u2") and len(shard) == row.docs and shard[0][-1] == 1


def test_indexes_are_validated():
    data = tokenfile.index_bytes(np.dtype("<u2"), [3, None], [5, 7])
    kind, ids, offsets = tokenfile.read_index(data)
    assert kind == np.dtype("<u2") and ids.tolist() == [3, tokenfile.NO_ID] and offsets.tolist() == [0, 5, 12]
    for bad in (data[:-1], b"X" + data[1:]):
        with pytest.raises(ValueError):
            tokenfile.read_index(bad)


# packing ----------------------------------------------------------------------------------------------------------
def fill(counts, limit):
    plan = packing.plan(counts, limit)
    used, total = np.zeros(limit + 1, int), 0
    for times, first, parts in plan.patterns:
        assert first == total and sum(n * k for n, k in parts) <= limit
        total += times
        for n, k in parts:
            used[n] += times * k
    assert total == plan.sequences and (used == counts).all()
    return plan


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(2)
    for limit in (8, 50, 4096):
        for _ in range(10):
            counts = np.zeros(limit + 1, int)
            np.add.at(counts, np.minimum(limit, 1 + (rng.exponential(limit / 6, 3000)).astype(int)), 1)
            plan = fill(counts, limit)
            least = -(-int((counts * np.arange(limit + 1)).sum()) // limit)
            assert plan.sequences <= least * 1.01 + 1
    assert fill(np.zeros(9, int), 8).sequences == 0
    halves = np.zeros(11, int)
    halves[5], halves[6] = 7, 3
    assert fill(halves, 10).sequences == 7


def test_exact_complements_come_first():
    counts = np.zeros(11, int)
    counts[[7, 6, 4, 3, 2, 1]] = [1, 1, 1, 1, 1, 1]
    plan = fill(counts, 10)
    assert [sorted(n for n, _ in p) for _, _, p in plan.patterns][:2] == [[3, 7], [4, 6]]
    sums = packing.Sums(np.array([0, 1, 1, 0, 1, 2, 0, 0, 0, 0, 0]))
    assert sums.exact(5) == (5,) and sums.pair(6) == (5, 1) and sums.pair(10) == (5, 5) and sums.triple(7) == (4, 2, 1)
    assert sums.pair(2) is None and sums.triple(14) == (5, 5, 4) and sums.triple(13) is None


def test_every_rank_has_its_own_place():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 60, 33)
    counts[0] = 0
    plan = packing.plan(counts, 32)
    segments = packing.places(plan, 32)
    lengths = np.repeat(np.arange(33), counts)
    ranks = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = packing.assign(lengths, ranks, segments)
    held = {}
    for s, o, n in zip(sequence, offset, lengths, strict=True):
        held.setdefault(s, []).append((o, n))
    assert set(held) == set(range(plan.sequences))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 32


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    code = wordbpe.coder(wordbpe.default_path())
    ids = {i: np.array([*code.library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    rows = op10_best_fit_packing(spark, SF).collect()
    seen, held = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.start == r.piece * packing.LIMIT
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.LIMIT
    assert len(held) <= -(-sum(map(len, ids.values())) // packing.LIMIT) + 1


def test_sums_are_those_of_what_is_left():
    """The index against all pairs and triples, while lengths run out one after the other."""
    import itertools

    rng = np.random.default_rng(3)
    for limit in (12, 30):
        for _ in range(12):
            counts = rng.integers(0, 5, limit + 1) * (rng.random(limit + 1) < 0.6)
            counts[0] = 0
            sums = packing.Sums(counts)
            while sums.left.any():
                there = np.flatnonzero(sums.left).tolist()
                fit = [[x for x in itertools.combinations_with_replacement(there, k) if all(sums.left[n] >= x.count(n) for n in set(x))] for k in (2, 3)]
                for t in range(1, limit + 1):
                    for table, find, every in ((sums.pairs, sums.pair, fit[0]), (sums.triples, sums.triple, fit[1])):
                        own = [x for x in every if sum(x) == t]
                        assert table[t] == len(own)
                        found = find(t)
                        assert tuple(sorted(found)) in own and max(found) == max(map(max, own)) if own else found is None
                n = int(rng.choice(there))
                sums.take(n, int(rng.integers(1, sums.left[n] + 1)))


def test_exact_fills_come_from_the_index(monkeypatch):
    """Every gap that one, two or three lengths fill is filled by them, and only those are asked for."""
    asked = []
    exact = packing.Sums.exact

    def told(self, gap):
        got = exact(self, gap)
        asked.append((gap, got, bool(self.left[gap] or self.pairs[gap] or self.triples[gap])))
        return got

    monkeypatch.setattr(packing.Sums, "exact", told)
    counts = np.zeros(101, np.int64)
    counts[[70, 20, 10, 60, 25, 15, 33, 7]] = (4, 4, 4, 3, 6, 3, 9, 2)
    plan = packing.plan(counts, 100)
    assert all((got is not None) == there and (got is None or sum(got) == gap) for gap, got, there in asked)
    used = np.zeros(101, np.int64)
    for times, _, parts in plan.patterns:
        assert sum(n * k for n, k in parts) <= 100
        for n, k in parts:
            used[n] += times * k
    assert (used == counts).all() and plan.sequences == sum(t for t, _, _ in plan.patterns)


def test_frames_of_streaming_writers_are_read():
    known = b"<html><body>some words that pages share</body></html>" * 20
    words = {"dict_data": zstandard.ZstdCompressionDict(known)}
    records = [warc.make_record(k, "http://a.org/", payload, warc.hashlib.sha256(payload).hexdigest()) for k, payload in enumerate((b"a" * 300, b"", b"b" * 3_000_000))]
    content = warc.opening(known)
    for record in records:
        out = zstandard.ZstdCompressor(write_content_size=False, **words).compressobj()
        frame = out.compress(record) + out.flush()
        assert zstandard.frame_content_size(frame) == -1
        content += frame + struct.pack("<II", 0x184D2A50, 3) + b"xyz"
    assert [len(r.payload) for r in warc.read_archive(content)] == [300, 0, 3_000_000]
    with pytest.raises(warc.BadRecord):
        list(warc.read_archive(content[:-2]))
    with pytest.raises(warc.BadRecord):
        list(warc.read_archive(content[: len(content) // 2]))


def test_records_are_bounded(monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 1000)
    record = warc.make_record(1, None, b"a" * 5000, warc.hashlib.sha256(b"a" * 5000).hexdigest())
    out = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    for frame in (zstandard.ZstdCompressor().compress(record), out.compress(record) + out.flush()):
        with pytest.raises(warc.BadRecord):
            list(warc.read_archive(frame))
