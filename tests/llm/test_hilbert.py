import zlib
from collections import Counter

import numpy as np

from panelforge.llm import hilbert
from panelforge.llm.queries import op3_hilbert_sharding


def test_curve_visits_each_cell_once_and_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert.hilbert_index(cells, bits)
        assert sorted(index) == list(range(side**dims))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_query_law(spark, sf):
    rows = op3_hilbert_sharding(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)


def test_bytes_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = hilbert.assign(docs, shards=4, law="bytes").collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r["size"]
    most = max(r["size"] for r in rows)
    assert max(sums.values()) - min(sums.values()) <= 2 * most
    for k in sums:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_shards_prune(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = hilbert.sharded(docs, 8)
    spans = hilbert.shard_ranges(out, ["lang"]).collect()
    assert sum(r.n_rows for r in spans) == docs.count()
    assert sum(r.min_lang <= 'es' <= r.max_lang for r in spans) < 8


def test_texts_with_a_common_prefix_keep_their_cells(spark):
    """Sources that start alike are told apart by their whole names."""
    rows = [(i, "t", f"https://example.org/{'abcdefgh'[i % 8]}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = hilbert.shard_ranges(hilbert.sharded(docs, 8, ("source",)), ["source"]).collect()
    assert all(r.min_source == r.max_source for r in out) and len({r.min_source for r in out}) == 8


def test_awkward_rows(awkward, empty, tmp_path):
    rows = hilbert.assign(awkward, shards=24).collect()
    assert len(rows) == awkward.count() and len({(r.shard, r.slot) for r in rows}) == len(rows)
    none = [r for r in rows if r.doc_id == 4][0]
    assert none["size"] == 8 and none.text_crc32 is None
    out = hilbert.sharded(awkward, 24)
    assert out.count() == awkward.count() and dict(out.dtypes)["shard"] == "int" and "position" in out.columns
    assert hilbert.assign(empty).count() == 0 and hilbert.sharded(empty).count() == 0
    hilbert.write_shards(awkward, str(tmp_path / "shards"), 3)
    assert awkward.sparkSession.read.parquet(str(tmp_path / "shards")).count() == awkward.count()
