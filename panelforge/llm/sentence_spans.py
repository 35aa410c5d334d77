"""Substring dedup by sliding spans of sentences.

A text is cut into sentences: after a word that ends in ``.``, ``!`` or ``?``, and at line breaks. Texts without such marks, and passages that
start or end in the middle of a sentence, would hold no whole sentences in common, so sentences are cut further: after the word with the least hash
(the last of equals) of every ``WINDOW`` consecutive words. Where these cuts fall depends on the words around them alone, so that a passage is cut alike wherever
it stands, in pieces of ``WINDOW`` words at most. From every sentence starts one span: the shortest run of
consecutive sentences with at least ``least_sentences`` of them and ``least_words`` words. Spans are hashed (lower case, words only; 128
bits) and joined globally; the first span of a hash, in the order of document and place, stays, and
the sentences covered by any other one are removed. Any 50 words, punctuated or not,
hold such a span whole, while shorter stock phrases don't.

The join is one shuffle of hashes, ids and places, sorted so that equal hashes meet. The hashes that are most frequent in a sample of
documents are dealt in pieces; the first places of a hash's pieces are compared afterwards. A text's later copies of its own spans are found where it is cut. Whole texts move once, to be cut.

Defined results: null and empty texts have no sentences and stay as they are; a repeat within a document
counts like one between documents; rows equal in id and text count as one document; null ids come last
in the order. Input columns named ``n_sentences``, ``n_removed`` or ``removed`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_of, materialise, text_bytes, with_key

#: A cut within every so many words: with 10, any 50 words hold a span (the first cut comes after 10 words at most, a span ends at most 30 words on, and the last 10 words can't change it).
WINDOW = 10
#: Hashes that are dealt in pieces at most, and one of how many documents is looked at to find them.
HOT, SAMPLE = 1 << 15, 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
#: Fixed by choice: odd bases of the polynomial hashes of bytes and of words.
_BYTES, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_POWERS = {base: _Powers(base) for base in (_BYTES, _FIRST, _SECOND)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _runs(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each run ``values[begin:end]``, by differences of one running sum."""
    up, down = _POWERS[base].upto(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sentences(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after, words) of each sentence, and the hash of every word."""
    data = np.frombuffer(raw, np.uint8)
    gap = _SPACE[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(starts)
    if not n:
        return starts, ends, starts, np.zeros(0, np.uint64)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    cut = _STOP[data[ends - 1]]
    cut[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    cut[-1] = True
    hashed = _runs(np.frombuffer(raw.lower(), np.uint8).astype(np.uint64), starts, ends, _BYTES)
    if n >= WINDOW:
        least = WINDOW - 1 - np.lib.stride_tricks.sliding_window_view(hashed, WINDOW)[:, ::-1].argmin(axis=1)
        cut[np.arange(len(least)) + least] = True
    at = np.flatnonzero(cut)
    first = np.concatenate([[0], at[:-1] + 1])
    return starts[first], ends[at], np.diff(at, prepend=-1), hashed


def spans(raw: bytes, least_sentences: int = 3, least_words: int = 20, parts=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes, first sentence, sentence after) of the span that starts at each sentence, as far as the text goes; ``parts``: the text's ``sentences``, where they are known."""
    a, _, words, hashed = parts or sentences(raw)
    n = len(a)
    if n < least_sentences:
        return *np.zeros((2, 0), np.uint64), *np.zeros((2, 0), np.int64)
    upto = np.concatenate([[0], np.cumsum(words)])
    after = np.maximum(np.searchsorted(upto, upto[:-1] + least_words), np.arange(n) + least_sentences)
    begin = np.flatnonzero(after <= n)
    after = after[begin]
    number = (after - begin).astype(np.uint64)  # equal spans are cut alike
    one, two = (_runs(v, upto[begin], upto[after], base) for v, base in ((hashed, _FIRST), (_mix(hashed), _SECOND)))
    return _mix(one + number), _mix(two + number), begin, after


def _again(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether each span of a text is the same as an earlier one of it."""
    order = np.lexsort((two, one))  # stable
    later = np.zeros(len(one), bool)
    later[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    return later


def _named(docs: DataFrame, id_col: str, twice: bool) -> DataFrame:
    """``with_key``; where no id is there twice, the id names the text alone and ``__hash`` is 0, which costs nothing to shuffle."""
    rows = with_key(docs, id_col)
    return rows if twice else rows.withColumn("__hash", F.lit(0).cast("long"))


def _each(rows: DataFrame, least_sentences: int, least_words: int, hot: dict[tuple[int, int], int]) -> DataFrame:
    """(``__id``, ``__hash``, two hashes ``s`` and ``t``, ``u``, ``place``) of every text's different spans; ``u`` is a piece of a hot hash, -1 for any other."""
    keys = np.array(sorted(hot), np.int64).reshape(-1, 2)
    pieces = np.array([hot[tuple(k)] for k in keys.tolist()], np.uint64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                found = []
                for t in b.column(2):
                    each = spans(t.as_py(), least_sentences, least_words)
                    new = ~_again(*each[:2])
                    found.append([x[new] for x in each])
                lens = [len(f[0]) for f in found]
                take = np.repeat(np.arange(b.num_rows), lens)
                one, two, first, after = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
                one, two = one.view(np.int64), two.view(np.int64)
                piece = np.full(len(one), -1, np.int32)
                if len(keys):
                    near = np.minimum(np.searchsorted(keys[:, 0], one), len(keys) - 1)
                    hit = np.flatnonzero((keys[near, 0] == one) & (keys[near, 1] == two))
                    pick = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)[take[hit]]
                    piece[hit] = pick % pieces[near[hit]]
                place = first.astype(np.int64) << 20 | (after - first).astype(np.int64)  # a span has fewer sentences than words, and few of these
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), *map(pa.array, (one, two, piece, place))], ["__id", "__hash", "s", "t", "u", "place"])

    kinds = {"s": T.LongType(), "t": T.LongType(), "u": T.IntegerType(), "place": T.LongType()}
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *(T.StructField(c, k) for c, k in kinds.items())]))


def _hot(rows: DataFrame, least_sentences: int, least_words: int) -> dict[tuple[int, int], int]:
    """The most frequent hashes in the spans of one document in ``SAMPLE``, at most ``HOT``, and how many pieces each is dealt into.

    Any hash beyond these has about one ``HOT``-th of all spans at most. Which hashes are hot changes only where rows are sorted, never what is found.
    """
    some = _each(rows.filter(F.pmod("__pick", F.lit(SAMPLE)) == 0), least_sentences, least_words, {})
    top = some.groupBy("s", "t").count().filter("count >= 8").orderBy(F.desc("count"), "s", "t").limit(HOT).collect()
    total = sum(r["count"] for r in top)
    return {(r.s, r.t): min(HOT * r["count"] // total + 1, r["count"] // 4) for r in top}  # 2 x HOT pieces at most


def repeated(docs: DataFrame, twice: bool, least_sentences: int = 3, least_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """(``__id``, ``__hash`` as ``_named`` has it, ``__cover``: [first, after) sentences of the spans that an earlier document holds; of a document's equal spans the first alone is told)."""
    rows = _named(docs.select(F.col(id_col).alias("__id"), "text"), "__id", twice)
    if twice:
        rows = rows.dropDuplicates(["__key", "__hash"])
    rows = rows.select("__id", "__hash", text_bytes().alias("__text"), F.xxhash64("__key", "__hash").alias("__pick"))
    each = _each(rows, least_sentences, least_words, _hot(rows, least_sentences, least_words))
    # The only shuffle of all spans: sorted, every row after the first of its hash is a repeat. A hot hash has a first row for each piece.
    order = [F.col("__id").isNull(), F.col("__id"), F.col("__hash"), F.col("place")]
    nth = F.row_number().over(W.partitionBy("s", "t", "u").orderBy(*order))
    rest = materialise(each.withColumn("nth", nth).filter("nth > 1 or u >= 0"))
    key = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__hash").alias("hash"), F.col("place").alias("place"))
    firsts = rest.filter("u >= 0 and nth = 1").groupBy("s", "t").agg(F.min(key).alias("p"))  # at most HOT rows
    same = F.col("__id").eqNullSafe(F.col("p.id")) & (F.col("__hash") == F.col("p.hash")) & (F.col("place") == F.col("p.place"))
    later = rest.join(F.broadcast(firsts), ["s", "t"], "left").filter((F.col("u") < 0) | ~same)
    covers = later.groupBy("__id", "__hash").agg(F.collect_set("place").alias("__places"))
    return covers.select("__id", "__hash", F.transform("__places", lambda p: F.array(F.shiftright(p, 20), F.shiftright(p, 20) + p.bitwiseAND(F.lit((1 << 20) - 1)))).alias("__cover"))


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id is there more than once."""
    return not docs.groupBy(id_col).count().filter("count > 1").limit(1).isEmpty()


def remove_repeats(docs: DataFrame, least_sentences: int = 3, least_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """Whole rows with ``text`` cut, ``n_sentences``, ``n_removed`` (sentences) and ``removed`` ([from, to) bytes of the old text)."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_sentences", "n_removed", "removed")))
    names = docs.columns
    twice = _repeats(docs, id_col)
    rows = _named(docs, id_col, twice)
    cover = repeated(docs, twice, least_sentences, least_words, id_col).select(key_of("__id").alias("__key"), "__hash", "__cover")
    rows = rows.join(cover, ["__key", "__hash"], "left")
    rows = rows.select(*names, text_bytes().alias("__raw"), "__cover")
    at, n = names.index("text"), len(names)
    extra = T.StructType([T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches):
        for b in batches:
            new, counts, gone, removed = [], [], [], []
            for text, raw, covers in zip(b.column(at), b.column(n), b.column(n + 1), strict=True):
                raw, covers = raw.as_py(), covers.as_py() or ()
                first, after, *_ = parts = sentences(raw)
                counts.append(len(first))
                one, two, begin, upto = spans(raw, least_sentences, least_words, parts)
                own = _again(one, two)  # these need no join
                if not covers and not own.any():
                    new.append(text.as_py())
                    gone.append(0)
                    removed.append([])
                    continue
                flag = np.zeros(len(first) + 1, np.int64)
                np.add.at(flag, begin[own], 1)
                np.add.at(flag, upto[own], -1)
                for s, e in covers:
                    flag[s] += 1
                    flag[e] -= 1
                hit = np.cumsum(flag)[:-1] > 0
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                cuts = [(int(first[s]), int(first[e]) if e < len(first) else len(raw)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                out, place = [], 0
                for s, e in cuts:
                    out.append(raw[place:s])
                    place = e
                out.append(raw[place:])
                new.append(b"".join(out).decode())
                gone.append(int(hit.sum()))
                removed.append([list(c) for c in cuts])
            columns = [*b.columns[:n]]
            columns[at] = pa.array(new, b.schema.field(at).type)
            more = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, *extra.names])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, *extra.fields]))
