import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import fm_index as fm
from panelforge.llm.queries import op4_fm_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(texts, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


_text = st.lists(st.sampled_from(["a", "b", "A,", "c", "é", "zz"]), max_size=30).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(_text, max_size=5), st.lists(_text, max_size=3), st.integers(1, 4))
def test_scan_against_brute_force(texts, items, size):
    numbered = list(enumerate(items))
    got = fm.Phrases(numbered, size).scan([t.encode() for t in texts])
    assert [(n, sum(e - s for s, e in sp), i) for n, sp, i in got] == slow(texts, numbered, size)


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 300)
    text[-1] = 0
    order = fm.suffix_array(text)
    ends = np.flatnonzero(text == 0)
    key = lambda i: [(0, j) if text[j] == 0 else (1, int(text[j])) for j in range(i, ends[np.searchsorted(ends, i)] + 1)]
    assert list(order) == sorted(range(300), key=key)
    tree = fm.WaveletMatrix(text, 2)
    for c in range(4):
        assert [int(x) for x in tree.rank(np.full(301, c), np.arange(301))] == [int((text[:i] == c).sum()) for i in range(301)]


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = dict(zip(docs, slow(docs.values(), items, 10), strict=True))
    for r in op4_fm_decontamination(spark, sf).collect():
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_blocks_and_shards_change_nothing(spark, awkward):
    items = spark.createDataFrame([(1, "quick brown fox jumps over"), (2, "every day rain"), (3, None), (None, "lazy dog"), (4, ""), (5, "every day rain or shine without fail")], "item_id long, text string")
    one = sorted(map(str, fm.contamination(awkward, items, 5).collect()))
    assert one == sorted(map(str, fm.contamination(awkward, items, 5, block_words=3, shard_bytes=50).collect()))
    assert any("hit_items=['1'" in x for x in one)


def test_removal(spark, awkward, empty):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the"), (2, "a row without an id")], "item_id long, text string")
    out = fm.remove_contamination(awkward, items, 6)
    assert out.columns == awkward.columns
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    cut = [r for r in rows.values() if r.doc_id == 1][0]
    assert cut.text == "The lazy dog. It does so every day, rain or shine, without fail." and cut.n_chars == len(cut.text)
    assert not any(r.text == "a row without an id" for r in rows.values()) and (4, None) in rows
    assert all(not f.hit_spans for f in fm.contamination(out, items, 6).collect())
    none = spark.createDataFrame([], "item_id long, text string")
    assert fm.remove_contamination(awkward, none, 6).count() == awkward.count()
    assert fm.remove_contamination(empty, items, 6).count() == 0 and fm.contamination(empty, items).count() == 0


def test_cuts_that_bring_a_phrase_together(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "keep one two one two three four three four this", 0)], "doc_id long, text string, n_chars int")
    row = fm.remove_contamination(docs, items, 4).first()
    assert row.text.split() == ["keep", "this"] and row.n_chars == len(row.text)
