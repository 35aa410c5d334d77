"""Benchmark decontamination with an FM-index per training shard.

Test phrases are all windows of ``window`` consecutive words of an item (a shorter item is one window).
A shard is a bounded run of documents inside a task. Words become numbers of the phrases' alphabet;
words that no phrase holds can be in no occurrence, so runs of them close a segment, and segments
shorter than the shortest phrase go. Over the remaining numbers the shard builds a suffix array
(prefix doubling over segments with ends of their own), its Burrows-Wheeler transform in a wavelet
matrix, and sampled suffix positions. All phrases are searched backward at once, each step two rank
queries; occurrences are located by walking back to a sampled position; the spans of a document are
merged. Nothing is shuffled: results leave on the rows that came in.

The benchmark is compiled on the driver in blocks of at most about ``block_words`` words, each
broadcast, so a large benchmark costs more passes over the documents' words, and no larger index.

Defined results: null and empty texts have no words and no hits; items without words are in no
document; repeated items share an id in the result; null item ids are left out; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, text_bytes

#: Every so many suffix positions are kept; locating walks at most so many steps less one.
SAMPLE = 8


class WaveletMatrix:
    """Symbols under 2**levels; ``zeros[l][i]`` counts 0 bits among the first i of level l, so a rank is one lookup a level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.zeros, self.ends = levels, [], []
        for shift in range(levels - 1, -1, -1):
            bit = (symbols >> shift) & 1
            counts = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit ^ 1, out=counts[1:], dtype=np.int32)
            self.zeros.append(counts)
            self.ends.append(int(counts[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """How often each symbol is among the first ``upto``."""
        low = np.zeros_like(upto)
        at = upto
        for l in range(self.levels):
            one = ((symbol >> (self.levels - 1 - l)) & 1).astype(bool)
            z, end = self.zeros[l], self.ends[l]
            z_at, z_low = z[at], z[low]
            at = np.where(one, end + at - z_at, z_at)
            low = np.where(one, end + low - z_low, z_low)
        return at - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for l in range(self.levels):
            z, end = self.zeros[l], self.ends[l]
            z_at, z_low = z[at], z[low]
            one = z[at + 1] == z_at
            symbol = (symbol << 1) | one
            at = np.where(one, end + at - z_at, z_at)
            low = np.where(one, end + low - z_low, z_low)
        return symbol, at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. ``text``: numbers, 0 closes a segment; each 0 is a smallest symbol of its own, in order of place."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    width = 1
    sorted_rank = rank[order]
    dense = np.empty(n, np.int64)
    dense[order] = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])]) if n else []
    rank = dense
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        width *= 2
    return order


class FMIndex:
    """Full-text index of segments of numbers from 1; every segment is closed by a 0."""

    def __init__(self, text: np.ndarray, alphabet: int):
        self.n = len(text)
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.first = np.zeros(alphabet + 2, np.int64)  # rows of suffixes that start with a smaller symbol
        self.first[1:] = np.cumsum(np.bincount(text, minlength=alphabet + 1))
        self.bwt = WaveletMatrix(before.astype(np.int64), max(1, int(alphabet).bit_length()))
        kept = (order % SAMPLE == 0) | (before == 0)  # never walk over a segment's start
        self.kept = kept
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the patterns (rows of numbers from 1, aligned right)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1] if len(patterns) else 0
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            c = patterns[live, width - 1 - step]
            low[live] = self.first[c] + self.bwt.rank(c, low[live])
            high[live] = self.first[c] + self.bwt.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, steps = np.zeros(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            found = self.kept[at]
            out[todo[found]] = self.positions[self.kept_rank[at[found]]] + steps
            todo, at = todo[~found], at[~found]
            if len(at):
                symbol, rank = self.bwt.access_rank(at)
                at = self.first[symbol] + rank
            steps += 1
        return out


class Phrases:
    """The windows of a block of items: an alphabet, patterns as rows of numbers, and the items of each pattern."""

    def __init__(self, items: list[tuple], window: int):
        self.window, self.alphabet = window, {}
        patterns: dict[tuple, set] = {}
        for item, text in items:
            words = [self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in alnum_words((text or "").encode())]
            if words and item is not None:
                for i in range(max(1, len(words) - window + 1)):
                    patterns.setdefault(tuple(words[i : i + window]), set()).add(str(item))
        self.items = [sorted(x) for x in patterns.values()]
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.rows = np.zeros((len(patterns), window), np.int64)
        for i, p in enumerate(patterns):
            self.rows[i, window - len(p) :] = p

    def occurrences(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, pattern) of every occurrence, from a shard of documents as numbers (0: not in the alphabet)."""
        none = np.zeros(0, np.int64)
        if not len(self.items) or not docs:
            return none, none, none
        shortest = int(self.lengths.min())
        offsets = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
        text = np.zeros(offsets[-1], np.int32)
        for d, at in zip(docs, offsets, strict=False):
            text[at : at + len(d)] = d
        ends = np.flatnonzero(text == 0)  # each document ends with a 0
        runs = np.diff(ends, prepend=-1) - 1
        long = runs >= shortest
        if not long.any():
            return none, none, none
        keep = np.zeros(len(text) + 1, np.int32)
        np.add.at(keep, ends[long] - runs[long], 1)
        np.add.at(keep, ends[long] + 1, -1)
        places = np.flatnonzero(np.cumsum(keep)[:-1])
        index = FMIndex(text[places].astype(np.int64), len(self.alphabet))
        low, high = index.search(self.rows, self.lengths)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return none, none, none
        counts = (high - low)[hit]
        pattern = np.repeat(hit, counts)
        rows = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = places[index.locate(rows)]
        doc = np.searchsorted(offsets, at, side="right") - 1
        return doc, at - offsets[doc], pattern

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(number of words, merged [from, to) spans of hit words, items) of each text of a shard."""
        get = self.alphabet.get
        numbers, sizes = [], []
        for t in texts:
            words = alnum_words(t)
            sizes.append(len(words))
            numbers.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        doc, start, pattern = self.occurrences(numbers)
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        order = np.lexsort((start, doc))
        for d, s, p in zip(doc[order].tolist(), start[order].tolist(), pattern[order].tolist(), strict=True):
            end = s + int(self.lengths[p])
            if spans[d] and s <= spans[d][-1][1]:
                spans[d][-1][1] = max(spans[d][-1][1], end)
            else:
                spans[d].append([s, end])
            items[d].update(self.items[p])
        return [(n, [tuple(x) for x in s], sorted(i)) for n, s, i in zip(sizes, spans, items, strict=True)]


def phrase_blocks(benchmark: DataFrame, window: int, block_words: int) -> list[Phrases]:
    """The benchmark's phrases, compiled a block at a time; the driver holds one block's texts at once."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = benchmark.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    n = max(1, -(-total // block_words))
    own = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
    return [Phrases([tuple(r) for r in benchmark.filter(own == k).select("item_id", "text").collect()], window) for k in range(n)]


def _shards(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most`` bytes of text, or one longer document."""
    for batch in batches:
        texts, begin, held = [], 0, 0
        for i, t in enumerate(batch.column(column)):
            b = t.as_py() or b""
            if texts and held + len(b) > most:
                yield batch.slice(begin, len(texts)), texts
                texts, begin, held = [], i, 0
            texts.append(b)
            held += len(b)
        if texts:
            yield batch.slice(begin, len(texts)), texts


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("hit_items", T.ArrayType(T.StringType()))]


def _merge(a: list, b: list) -> list:
    out: list[list[int]] = []
    for s, e in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", block_words: int = 2_000_000, shard_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: id, ``n_words``, ``hit_spans`` (merged [from, to) of words), ``hit_items`` (ids as strings, sorted)."""
    rows = docs.select(F.col(id_col).alias("__id"), text_bytes().alias("__text"))
    blocks = phrase_blocks(benchmark, window, block_words)
    spark = docs.sparkSession
    for k, block in enumerate(blocks):
        held, first, last = spark.sparkContext.broadcast(block), k == 0, k == len(blocks) - 1

        def run(batches, held=held, first=first, last=last):
            phrases = held.value
            for part, texts in _shards(batches, 1, shard_bytes):
                found = phrases.scan(texts)
                n, spans, items = ([x[i] for x in found] for i in range(3))
                if not first:
                    spans = [_merge(a, b) for a, b in zip(part.column(3).to_pylist(), spans, strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(part.column(4).to_pylist(), items, strict=True)]
                new = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
                kept = [part.column(0)] if last else [part.column(0), part.column(1)]
                yield pa.RecordBatch.from_arrays([*kept, *new], (["__id"] if last else ["__id", "__text"]) + [f.name for f in _FOUND])

        fields = rows.schema.fields[:1] if last else rows.schema.fields[:2]
        rows = rows.mapInArrow(run, T.StructType([*fields, *_FOUND]))
    return rows.withColumnRenamed("__id", id_col)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stood between them."""
    raw = text.encode()
    flags = np.frombuffer(raw.translate(_IS_WORD), np.uint8)
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = int(ends[e - 1])
        if raw[at : at + 1] == b" " and out[-1][-1:] in (b"", b" ", b"\n"):
            at += 1  # not two spaces where the words were
    out.append(raw[at:])
    return b"".join(out).decode()


_IS_WORD = bytes(int(c > 127 or chr(c).isalnum()) for c in range(256))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, shard_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """``docs`` with every occurrence of a phrase cut out of the texts; ``n_chars``, where there, follows the text.

    Cutting can bring words together that form a phrase again, so cut texts are searched until none
    is left. A document that consisted of phrases alone has no words left and goes.
    """
    spark = docs.sparkSession
    names = docs.columns
    at = names.index(text_col)
    size = names.index("n_chars") if "n_chars" in names else None
    held = [spark.sparkContext.broadcast(b) for b in phrase_blocks(benchmark, window, block_words)]
    marked = docs.withColumn("__raw", text_bytes(text_col))

    def run(batches):
        for part, texts in _shards(batches, len(names), shard_bytes):
            now: dict[int, str] = {}
            todo = list(range(len(texts)))
            while todo:
                again = {}
                for h in held:
                    seen = [now[i].encode() if i in now else texts[i] for i in todo]
                    for i, t, (_, spans, _i) in zip(todo, seen, h.value.scan(seen), strict=True):
                        if spans:
                            now[i] = _cut(t.decode(), spans)
                            again[i] = True
                todo = sorted(again)
            columns = [part.column(i) for i in range(len(names))]
            if now:
                new = part.column(at).to_pylist()
                for i, t in now.items():
                    new[i] = t
                columns[at] = pa.array(new, part.schema.field(at).type)
                if size is not None:
                    chars = part.column(size).to_pylist()
                    for i, t in now.items():
                        chars[i] = len(t)
                    columns[size] = pa.array(chars, part.schema.field(size).type)
            out = pa.RecordBatch.from_arrays(columns, names)
            if gone := [i for i, t in now.items() if not alnum_words(t.encode())]:
                keep = np.ones(part.num_rows, bool)
                keep[gone] = False
                out = out.filter(pa.array(keep))
            yield out

    return marked.mapInArrow(run, docs.schema)
