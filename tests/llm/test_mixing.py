import pytest

from panelforge.llm import mixing
from panelforge.llm.queries import op1_mix_sources


def water_fill(sizes, weights, budget, repeats=3):
    left, open_, out = budget, dict(sizes), {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if repeats * sizes[s] <= weights[s] * share]
        if not full:
            return out | {s: weights[s] * share for s in open_}
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def test_query_meets_targets(spark, sf):
    rows = op1_mix_sources(spark, sf).collect()
    again = {r.doc_id: r.taken for r in op1_mix_sources(spark, sf).collect()}
    assert {r.doc_id: r.taken for r in rows} == again
    names = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = names[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size >= r.size
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    want = water_fill(sizes, weights, sum(sizes.values()))
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-6) and abs(taken[s] - target[s]) <= 1


def test_capped_sources_give_their_share_away(spark):
    rows = [(i, "w " * 10, "big" if i < 90 else "tiny" if i < 93 else None) for i in range(95)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r for r in mixing.schedule(docs).collect()}
    assert got["tiny"].target == 90 and got[None].target == 60 and got["big"].target == pytest.approx(950 - 150)


def test_the_truncated_stream_is_in_order_and_full(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed, cut = mixing.stream(mixing.queues(docs).cache())
    rows = sorted(mixed.collect(), key=lambda r: r.position)
    assert [r.virtual_finish for r in rows] == sorted(r.virtual_finish for r in rows)
    assert all(r.virtual_start < cut + 1 and r.virtual_finish > r.virtual_start for r in rows)
    assert all(r.words == r.size for r in rows if r.virtual_finish < cut - 1)
    late = [r for r in rows if r.virtual_finish > cut + 1]  # in service at the cut: one a source at most
    assert len({r.source for r in late}) == len(late)
    words = {}
    for r in rows:
        words[r.id] = words.get(r.id, 0) + r.words
    planned = mixing.schedule(docs).collect()
    assert words == {r.doc_id: r.taken for r in planned if r.taken}
    assert sum(words.values()) == pytest.approx(sum(r.size for r in planned), abs=len({r.source for r in planned}))


def test_budgets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 5 == 0]) for i in range(60)], "doc_id long, text string, source string")
    for budget in (0.0, 0.1, 0.5, 1.5, 2.9, 4.0):
        rows = mixing.schedule(docs, budget=budget).collect()
        sizes = {s: sum(r.size for r in rows if r.source == s) for s in "ab"}
        want = water_fill(sizes, {"a": 1, "b": 2}, min(budget, 3) * sum(sizes.values()))
        for s in "ab":
            assert abs(sum(r.taken for r in rows if r.source == s) - want[s]) <= 1, (budget, s)


def test_awkward_rows(awkward, empty):
    rows = mixing.schedule(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.taken == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), abs=len({r.source for r in rows}))
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    assert out.count() == sum(r.copies for r in rows)
    assert mixing.schedule(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
