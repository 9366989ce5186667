import hashlib
import random
import re

import numpy as np
import pytest
from emberline.llm import neardup
from emberline.llm.components import connected_components
from emberline.llm.exact_dedup import CuckooIndex, digest_table, exact_dedup, group_index, update_index
from emberline.llm.queries import OP1_SQL, OP6_SQL, op1_exact_dedup, op6_near_duplicates

SF = "/root/testdata/sf0.001"


def test_index_against_a_dict():
    rng, index, live = random.Random(5), CuckooIndex(2), {}
    names = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for _ in range(20_000):
        d, i = rng.choice(names), rng.randrange(10**6)
        if rng.random() < 0.6:
            assert index.insert(d, i) == (d not in live)
            e = live.setdefault(d, [i, 0])
            e[0], e[1] = min(e[0], i), e[1] + 1
        elif rng.random() < 0.5:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            assert index.get(d) == live.get(d)
    assert len(index) == len(live) and dict(index.items()) == live
    assert index.mask + 1 > 256  # it was rebuilt on the way


def test_equal_fingerprints_are_told_apart():
    index = CuckooIndex(2)
    same = [b"\x01\x02" + b"\0" * 8 + bytes([k]) * 22 for k in range(6)]
    for k, d in enumerate(same):
        assert index.insert(d, k)
    assert [index.get(d)[0] for d in same] == list(range(6))
    assert index.delete(same[2]) and index.get(same[2]) is None and index.get(same[3]) == [3, 1]


def test_exact_against_sql(spark, check_rows):
    check_rows(op1_exact_dedup(spark, SF), OP1_SQL)


def test_exact_with_a_hot_text(spark):
    rows = [(k, "hot  text" if k % 3 == 0 else f"text {k % 50}") for k in range(600)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = {}
    for k, t in rows:
        groups.setdefault(key(t), []).append(k)
    for r in got:
        own = groups[key(dict(rows)[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
        assert r.text_sha256 == hashlib.sha256(key(dict(rows)[r.doc_id]).encode()).hexdigest()


def test_index_table_takes_deletions(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (7, "c"), (9, "c")], "doc_id long, text string")
    index = group_index(digest_table(docs))
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    gone = spark.createDataFrame([(sha("a"), 1), (sha("b"), None), (sha("c"), 1)], "digest binary, copies long")
    rest = digest_table(docs.where("doc_id not in (1, 3, 9)"))
    left = update_index(index, deleted=gone, live=rest)
    assert {bytes(r.digest): (r.keep_id, r.copies) for r in left.collect()} == {sha("a"): (2, 1), sha("c"): (4, 2)}
    again = update_index(left, added=spark.createDataFrame([(sha("b"), 9, 1)], "digest binary, keep_id long, copies long"))
    assert {bytes(r.digest): r.keep_id for r in again.collect()} == {sha("a"): 2, sha("b"): 9, sha("c"): 4}
    with pytest.raises(ValueError):
        update_index(index, deleted=gone)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


def test_near_against_sql(spark, check_rows):
    check_rows(op6_near_duplicates(spark, SF), OP6_SQL)


def brute(rows):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    """A large group of near copies at all distances from a base, passages shared by many, small groups, chains."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for _ in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = word()
        rows.append(w)
    for _ in range(80):
        rows.append([word() for _ in range(rng.randrange(5, 40))] + passage + [word() for _ in range(rng.randrange(5, 40))])
    chain = [word() for _ in range(200)]
    for k in range(12):
        rows.append(chain[k * 8 : k * 8 + 90])
    for _ in range(25):
        w = [word() for _ in range(rng.randrange(1, 30))]
        rows += [w, w[:-1] or w, [*w, word()]]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_near_against_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 80


def test_blocks_alone_find_every_component(spark, monkeypatch):
    """With tiny blocks and no other candidates, what tasks compare still joins what belongs together."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup._Search, "star", lambda self, placed, salts, least=0: placed.limit(0).selectExpr("rep a", "n an", "comp ac", "rep b", "n bn", "comp bc"))
    rows = corpus()[:220]
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_exact_products_and_single_intersections_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 90)) for _ in range(30)]
    m = neardup._common(sets[:15], sets[15:])
    assert all(m[a, b] == len(np.intersect1d(sets[a], sets[15 + b])) for a in range(15) for b in range(15))
    assert neardup._common(sets[:15], sets[15:], 3) is None


def test_shingles_are_words_of_ascii_space(spark):
    assert len(neardup.shingle_set("a b c d e f".encode())) == 1
    assert len(neardup.shingle_set(b"A b C d E f")) == 2
    assert (neardup.shingle_set(b"A b c") == neardup.shingle_set(b" a\tB\x0bC ")).all()
    assert neardup.shingle_set(b"a b c")[0] != neardup.shingle_set(b"a b c d")[0]
