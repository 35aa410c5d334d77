import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import simhash
from panelforge.llm.queries import op2_simhash_near_dedup


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB cÉ\t\n漢.", max_size=60))
def test_fingerprint_is_the_majority(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_majority_over_many_hashes():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert simhash.majority_bits(h) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > 1000)


def test_query_against_brute_force(spark, sf):
    rows = op2_simhash_near_dedup(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = slow_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_awkward_rows(spark, awkward, empty):
    got = {(r.doc_id, r.text_hash): r for r in simhash.near_duplicate_groups(awkward).collect()}
    by_id = {}
    for (i, _), r in got.items():
        by_id.setdefault(i, []).append(r)
    assert by_id[1][0].component_id == by_id[2][0].component_id == by_id[10][0].component_id == 1
    assert by_id[4][0].fp == by_id[5][0].fp == by_id[6][0].fp == 0 and by_id[6][0].component_id == 4
    assert simhash.near_duplicate_groups(empty).count() == 0
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[10] and ids[4] == 1 and not ids[5] and ids[7] == 1 and max(ids.values()) == 1
    assert simhash.keep_first(empty).count() == 0


def test_dense_shards_are_split(spark):
    """Many fingerprints within a few bits of each other: a small cap forces several levels, links stay whole."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    dense = {base ^ sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 5), replace=False)) for _ in range(300)}
    far = {int(x) for x in rng.integers(0, 1 << 62, 200)}
    values = sorted(dense | far)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, cap=20)).collect()}
    want = slow_components({v: v for v in values})
    assert {v: got.get(v, v) for v in values} == want


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    tree, values = simhash.BKTree(3), [int(x) for x in rng.integers(0, 1 << 10, 200)]
    for v in values:
        tree.add(v)
    for q in range(0, 1 << 10, 37):
        assert sorted(tree.near(q)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_wide_bits_are_majorities():
    h = np.random.default_rng(2).integers(0, 1 << 63, 300).astype(np.uint64)
    got = simhash.wide_majority(h, 3)
    for k in range(3):
        mixed = []
        for x in map(int, h):
            x ^= int(simhash._WORDS[k])
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
            mixed.append(x ^ x >> 31)
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > 300)


def test_keep_unlike_against_shingle_sets(spark, sf):
    """Classes are those of all pairs with a similarity of 0.8 or more, by brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in simhash.keep_unlike(docs).select("doc_id").collect()}
    sets = {r.doc_id: set(simhash.shingles(simhash.space_words(r.text.encode()), 5)) for r in docs.collect()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert kept == {i for i in ids if root(i) == i}


def classes(spark, texts, cap):
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in texts.items()}
    prints = spark.createDataFrame([(i, bytearray(simhash.wide_fingerprint(t.encode(), 5, 4))) for i, t in texts.items()], "node long, print binary")
    short = spark.createDataFrame([(i, bytearray(np.unique(h.astype(np.uint32)).astype("<u4").tobytes())) for i, h in sets.items()], "node long, set binary")
    roots = {r.node: r.root for r in simhash.components(simhash.similar_links(prints, short, 4, cap=cap)).collect()}
    return {i: roots.get(i, i) for i in texts}


def altered(rng, base, n, name):
    w = list(base)
    for at in rng.choice(len(base), n, replace=False):
        w[int(at)] = f"{name}x{at}"
    return " ".join(w)


def test_keep_unlike_splits_hot_shards(spark):
    """Hundreds of near copies in every shard: a small cap deals them on, and one document stays."""
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(400)]
    texts = {k: altered(rng, base, 1, f"other{k}") for k in range(150)} | {1000 + k: " ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for k in range(50)}
    roots = classes(spark, texts, 20)
    assert len({roots[k] for k in range(150)}) == 1 and all(roots[1000 + k] == 1000 + k for k in range(50))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_unlike(docs).collect()) == [0, *range(1000, 1050)]


def test_hot_shards_lose_no_link(spark):
    """Variants that are 0.8 alike with their original but not with each other hang together by one row, whether their shard is searched whole or in parts; those under 0.8 stay apart."""
    rng = np.random.default_rng(11)
    base = [f"word{i}" for i in range(400)]
    texts = {1000: " ".join(base)} | {k: altered(rng, base, 6 if k <= 200 else 14, f"v{k}") for k in range(1, 301)}
    sets = {i: set(simhash.shingles(simhash.space_words(t.encode()), 5)) for i, t in texts.items()}
    j = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = {k for k in range(1, 301) if j(1000, k) >= 0.8}
    assert len(near) > 190 and sum(j(1, k) < 0.8 for k in near) > 150
    whole, cut = classes(spark, texts, 1000), classes(spark, texts, 20)
    linked = lambda got: {k for k in range(1, 301) if got[k] == got[1000]}
    assert linked(whole) == linked(cut) and near <= linked(cut)
    assert all(max(j(k, m) for m in [1000, *near] if m != k) >= 0.8 for k in linked(cut))


def test_near_pairs_against_brute_force():
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    values = sorted({b ^ sum(1 << int(k) for k in rng.choice(60, int(n), replace=False)) for b in base for n in rng.integers(0, 14, 12)})
    for tight, wide in ((2, 6), (0, 3), (5, 12), (3, 3)):
        sure, again = simhash.near_pairs(values, tight, wide)
        d = lambda i, j: (values[i] ^ values[j]).bit_count()
        parent = list(range(len(values)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in sure:
            assert i < j and root(i) != root(j)
            parent[root(j)] = root(i)
        for i in range(len(values)):
            mine = {i}  # reached by steps within tight
            while more := {j for j in range(len(values)) if j not in mine and any(d(j, k) <= tight for k in mine)}:
                mine |= more
            assert mine == {j for j in range(len(values)) if root(j) == root(i)}
        for i in range(len(values)):
            assert (i in again) == any(root(j) != root(i) and d(i, j) <= wide for j in range(len(values)))


def test_alike():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 40, int(rng.integers(1, 60)))).astype("<u4") for _ in range(2))
        a, b = {*x.tolist()}, {*y.tolist()}
        for s in (0.5, 0.8):
            assert simhash.alike(x, y, s) == (len(a & b) >= s * len(a | b) - 1e-9)


def test_keep_unlike_awkward(awkward, empty):
    kept = simhash.keep_unlike(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[10] and ids[4] == 1 and not ids[5] and ids[7] == 1 and max(ids.values()) == 1
    assert simhash.keep_unlike(empty).count() == 0


def test_equal_fingerprints_of_unlike_sets(spark):
    """Long texts that differ in one word can have equal fingerprints: they are linked all the same."""
    base = [f"word{i}" for i in range(6000)]
    texts = {k: " ".join([*base[:-1], f"last{k}"]) for k in range(40)} | {100: " ".join(base)}
    prints = [simhash.wide_fingerprint(t.encode(), 5, 4) for t in texts.values()]
    assert len(set(prints)) < len(prints)
    for cap in (512, 5):
        assert len(set(classes(spark, texts, cap).values())) == 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_unlike(docs).collect()] == [0]


def test_components_alone_and_in_rounds(spark):
    """A chain, a star and random links: one task, forests of a few edges with rounds, and a plain search give the same classes."""
    rng = np.random.default_rng(4)
    edges = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(-30, 0)] + [tuple(map(int, x)) for x in rng.integers(1000, 1200, (120, 2))]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {x: x for e in edges for x in e}
    while any(want[a] != want[b] for a, b in edges):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    for alone in (1 << 17, 7):
        got = [(r.node, r.root) for r in simhash.components(df, alone).collect()]
        assert len(dict(got)) == len(got) and dict(got) == {k: v for k, v in want.items() if k != v}
    assert simhash.components(df.filter("a > 5000")).count() == 0


def test_small_graphs_take_few_stages(spark):
    """Stages cost disk and time of their own, however few rows they have: near copies on hundreds of documents don't take hundreds of stages, hot shards or not."""
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(400)]
    texts = {k: altered(rng, base, 6, f"v{k}") for k in range(600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sc = spark.sparkContext
    sc.setJobGroup("few-stages", "")
    try:
        simhash.keep_unlike(docs).count()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    ran = {s for j in told.getJobIdsForGroup("few-stages") for s in told.getJobInfo(j).stageIds if (i := told.getStageInfo(s)) and i.numCompletedTasks}
    assert 0 < len(ran) < 100
