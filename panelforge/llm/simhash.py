"""SimHash near-duplicate groups: word shingles, BK-tree linking, connected components.

A fingerprint has 64 bits; two documents link at ``radius`` or fewer differing bits. Only distinct
fingerprints are linked, so exact copies cost nothing. Trees over all fingerprints would grow with the
corpus and could not be broadcast, so each BK-tree covers one shard: the fingerprints that agree on
two of ``radius + 2`` blocks of bits. By the pigeonhole principle every linked pair meets in some
shard. A shard over ``cap`` fingerprints is split again by the bits that it leaves free; with 12 free
bits it can hold 4,096 at most, so the size of a tree is bounded whatever the data. Inside a shard a
union-find keeps one link per merge (a spanning forest), never all pairs.

``keep_unlike`` is the same for texts of a given similarity instead of a radius of 64 bits: three bits of 64
find only some of the texts that are 0.8 alike or more, so it takes wide fingerprints of the sets of shingles, whose
shards agree on seeded picks of bits. Texts whose fingerprints are three standard errors nearer than the similarity asks for are linked at once; those up to some standard errors
farther are candidates only, whose sets of shingles are compared. Candidates that hang together form a group, whose classes are compared in blocks
with the sets at hand: no list of pairs is ever written, only the links that are found.

Defined results: null and empty texts have fingerprint 0 and link like any other; null ids take part
but never name a component (a component of null ids only has a null id); repeated rows share a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise, space_words, text_bytes, with_key

_LANE = np.uint64(0x0101010101010101)


def shingles(words: list[bytes], size: int = 3) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def majority_bits(hashes: np.ndarray) -> int:
    """Bit b is 1 if set in over half of the hashes. Eight lanes of one byte are summed at a time, 255 hashes a block."""
    n = len(hashes)
    if not n:
        return 0
    blocks = -(-n // 255)
    padded = np.zeros(blocks * 255, np.uint64)
    padded[:n] = hashes
    out = 0
    for shift in range(8):
        lanes = ((padded >> np.uint64(shift)) & _LANE).reshape(blocks, 255).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(blocks, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if counts[byte] * 2 > n:
                out |= 1 << (8 * byte + shift)
    return out


#: Fixed by a rule: odd multiples of the golden ratio's 64 bits, one for each further word of a wide fingerprint.
_WORDS = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(64)], np.uint64)


def wide_majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` x 64 majority bits: every hash is mixed anew for each word."""
    n = len(hashes)
    if not n:
        return np.zeros(words, np.uint64)
    x = hashes[None, :] ^ _WORDS[:words, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    blocks = -(-n // 255)
    padded = np.zeros((words, blocks * 255), np.uint64)
    padded[:, :n] = x
    out = np.zeros(words, np.uint64)
    for shift in range(8):
        lanes = ((padded >> np.uint64(shift)) & _LANE).reshape(words, blocks, 255).sum(axis=2, dtype=np.uint64)
        ones = (lanes.view(np.uint8).reshape(words, blocks, 8).sum(axis=1, dtype=np.int64) * 2 > n).astype(np.uint64)
        out |= (ones << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(shift))).sum(axis=1, dtype=np.uint64)
    return out


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's distinct word shingles, sorted."""
    parts = set(shingles(space_words(text), size))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts)))


def wide_fingerprint(text: bytes, size: int, words: int) -> bytes:
    """A SimHash of 64 x ``words`` bits over the distinct word shingles; a text without words has none."""
    hashes = shingle_set(text, size)
    return wide_majority(hashes, words).astype("<u8").tobytes() if len(hashes) else b""


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text over the XXH64 of its word shingles, repeats included."""
    parts = shingles(space_words(text), size)
    return majority_bits(np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", size: int = 3, text_col: str = "text") -> DataFrame:
    """(id, ``text_hash``, ``fp`` signed long) for each row."""
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), text_bytes(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["__id", "text_hash", "fp"])

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, text_hash long, fp long").withColumnRenamed("__id", id_col)


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [[int(b) for b in x] for x in np.array_split(np.array(bits, dtype=np.int64), parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent; a search follows the edges within the radius only."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def near(self, value: int) -> list[int]:
        """Numbers of the stored values within the radius."""
        found, todo, radius, values, children = [], [0] if self.values else [], self.radius, self.values, self.children
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if kids := children[node]:
                todo += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
        return found

    def add(self, value: int) -> int:
        node, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            kids = self.children[node]
            d = (self.values[node] ^ value).bit_count()
            if d not in kids:
                kids[d] = new
                break
            node = kids[d]
        return new


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its class) for the classes within one shard that have more than one value."""
    if len(values) == 2:
        return [(values[1], values[0])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent = BKTree(radius), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        near = tree.near(v)
        x = tree.add(v)
        parent.append(x)
        for y in near:
            parent[root(x)] = root(y)
    least: dict[int, int] = {}
    for x, v in enumerate(values):
        r = root(x)
        least[r] = min(v, least.get(r, v))
    return [(v, least[root(x)]) for x, v in enumerate(values) if v != least[root(x)]]


def _spread(radius: int, first: bool):
    """Deals each fingerprint to the shards it belongs to: (key, fp, free) with ``free`` the bits that the shard doesn't fix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            key, fp, free = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(3))
            keys, fps, frees = [], [], []
            for mask in np.unique(free):
                own = free == mask
                if int(mask) not in plans:
                    bits = [b for b in range(64) if int(mask) >> b & 1]
                    parts = _blocks(bits, radius + 2 if first else radius + 1)
                    chosen = [_mask(sum(c, [])) for c in combinations(parts, 2 if first else 1)]
                    plans[int(mask)] = [(m, int(mask) & ~m) for m in chosen]
                for number, (fixed, rest) in enumerate(plans[int(mask)]):
                    mixed = (key[own] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((number + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
                    mixed = (mixed ^ (fp[own] & np.uint64(fixed))) * np.uint64(0xFF51AFD7ED558CCD)
                    mixed ^= mixed >> np.uint64(32)
                    keys.append(mixed)
                    fps.append(fp[own])
                    frees.append(np.full(int(own.sum()), rest, np.uint64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, fps, frees)], ["key", "fp", "free"])

    return run


def _trees(radius: int):
    """Rows come sorted by key; each run of one key is a shard with its own tree."""

    def links(keys: np.ndarray, fps: np.ndarray, out: list) -> None:
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        for a, b in zip(starts[many := ends - starts > 1], ends[many], strict=True):
            out += spanning_links([int(x) for x in np.unique(fps[a:b])], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on
            out: list[tuple[int, int]] = []
            if cut:
                links(keys[:cut], fps[:cut], out)
                keys, fps = keys[cut:], fps[cut:]
            if out:
                yield _pairs(out)
        out = []
        if len(keys):
            links(keys, fps, out)
        if out:
            yield _pairs(out)

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(out, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(distinct: DataFrame, radius: int = 3, cap: int = 2048) -> DataFrame:
    """(a, b) long: links between distinct fingerprints that connect the same classes as all links within the radius."""
    todo = distinct.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(-1).cast("long").alias("free"))
    found, first = None, True
    while True:
        dealt = materialise(todo.mapInArrow(_spread(radius, first), "key long, fp long, free long"))
        large = materialise(dealt.groupBy("key").agg(F.count("*").alias("n"), F.max("free").alias("f")).filter((F.col("n") > cap) & (F.bit_count("f") > 12)).select("key"))
        more = not large.isEmpty()
        small = dealt.join(large, "key", "left_anti") if more else dealt
        shards = small.repartition("key").sortWithinPartitions("key").select("key", "fp")
        new = shards.mapInArrow(_trees(radius), "a long, b long")
        found = new if found is None else found.unionByName(new)
        if not more:
            return materialise(found.distinct())
        todo, first = dealt.join(large, "key", "left_semi"), False


def _forest(most: int):
    """Rows (a, b), ``most`` at a time: a link (node, least of its class) for each node that is not the least one. The same classes hang together."""

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        found = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if n + part.num_rows > most:
                    yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
                held.append([c.to_numpy() for c in part.columns])
                n += part.num_rows
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def components(edges: DataFrame, alone: int = 1 << 17) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that is not its class's least one, the root.

    Every task first makes a forest of its edges. A graph of ``alone`` edges at most is then a task's work; larger ones take
    large-star and small-star rounds until nothing changes: a round is some ten shuffles, whatever the number of edges.
    """
    cur = materialise(edges.filter("a <> b").select("a", "b").mapInArrow(_forest(alone), "a long, b long"))
    if cur.count() <= alone:
        return materialise(cur.repartition(1).mapInArrow(_forest(alone), "node long, root long"))
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(small, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        cur = materialise(star.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(star.select(F.col("y").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return cur.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen = now


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", size: int = 3, radius: int = 3, cap: int = 2048) -> DataFrame:
    """One row per document: id, ``text_hash``, ``fp``, ``root`` (the class's smallest fingerprint), ``component_id`` (smallest id that can be reached, its own included)."""
    each = materialise(fingerprints(docs, id_col, size))
    distinct = each.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(distinct.select("fp"), radius, cap))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.select("fp", "root").join(classes, "root")
    return each.join(names, "fp").select(id_col, "text_hash", "fp", "root", "component_id")


def allowed_share(similarity: float) -> float:
    """Share of SimHash bits that differ between texts of that Jaccard similarity and equal length: the angle of their shingle vectors over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shard_plan(n: int, share: float, miss: float = 0.01) -> tuple[int, int]:
    """(bits of a shard's key, number of keys a fingerprint has): keys as long as the corpus needs, and so many that a pair at that share of differing bits misses all with chance ``miss`` at most."""
    bits = min(26, max(12, round(math.log2(max(2, n))) - 1))
    return bits, math.ceil(math.log(miss) / math.log1p(-((1 - share) ** bits)))


def _deal(words: int, width: int, keys: int, seed: int):
    """(key, node, print) for each of a fingerprint's keys: seeded picks of its bits, mixed with the shard it comes from."""
    picks = np.random.default_rng(seed).permuted(np.tile(np.arange(64 * words), (keys, 1)), axis=1)[:, :width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = np.zeros((64 * words, keys))
        for k in range(keys):
            take[picks[k], k] = 2.0 ** np.arange(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                raw = np.frombuffer(b"".join(x.as_py() for x in b.column(2)), np.uint8).reshape(b.num_rows, 8 * words)
                key = (np.unpackbits(raw, axis=1, bitorder="little") @ take).astype(np.uint64)
                outer = b.column(0).to_numpy().view(np.uint64)[:, None]
                key = (key + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD) ^ _WORDS[np.arange(keys) % 64][None, :] * np.uint64(1 + 2 * (seed % 1000)) ^ (np.arange(keys, dtype=np.uint64)[None, :] << np.uint64(7))
                key = (key ^ (key >> np.uint64(29)) ^ outer * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC4CEB9FE1A85EC53)
                rows = pa.array(np.repeat(np.arange(b.num_rows), keys))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), b.column(1).take(rows), b.column(2).take(rows)], ["key", "node", "print"])

    return run


def near_pairs(values: list[int], tight: int, wide: int) -> tuple[list[tuple[int, int]], set[int]]:
    """What one shard of distinct values holds, by a BK-tree: links within ``tight``, one for each merge, and the values that are within ``wide`` of one that these don't connect them with."""
    if len(values) == 2:
        d = (values[0] ^ values[1]).bit_count()
        return ([(0, 1)], set()) if d <= tight else ([], {0, 1}) if d <= wide else ([], set())
    tree, parent, loose = BKTree(wide), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        near = tree.near(v)
        x = tree.add(v)
        parent.append(x)
        for y in near:
            if (values[y] ^ v).bit_count() <= tight:
                a, b = sorted((root(x), root(y)))
                parent[b] = a  # the first value of a class is its root: shards of one group give the same links
            elif root(x) != root(y):
                loose.append((y, x))
    sure = [(root(x), x) for x in range(len(values)) if root(x) != x]
    return sure, {i for y, x in loose if root(x) != root(y) for i in (x, y)}


def _shard_pairs(tight: int, wide: int):
    """Rows (key, whole, node, print) come sorted by key; each run of one key is a shard, or where ``whole`` is told, a part of that shard. Gives (key, a, b): sure links, and with a = b the nodes that have candidates; of a part all nodes may have some, in the whole shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, whole, shard, out = None, None, {}, []

        def close() -> None:
            value = sorted(shard)
            nodes = [sorted(shard[v]) for v in value]
            sure, again = near_pairs([int.from_bytes(v, "little") for v in value], tight, wide) if len(value) > 1 else ([], set())
            out.extend((last, nodes[i][0], nodes[j][0]) for i, j in sure)
            out.extend((last, own[0], x) for own in nodes for x in own[1:])  # equal fingerprints of unlike sets
            if whole is not None:
                again = range(len(value))
            key = last if whole is None else whole
            out.extend((key, x, x) for i in again for x in nodes[i])

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "a", "b"])

        for batch in batches:
            for key, of, node, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    close()
                    last, whole, shard = key, of, {}
                shard.setdefault(p, set()).add(node)
            if len(out) > 1000:
                yield told()
                out.clear()
        close()
        if out:
            yield told()

    return run


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have the Jaccard similarity or more."""
    few, many = sorted((len(x), len(y)))
    if few < similarity * many - 1e-9:  # no overlap is large enough
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (few + many - common) - 1e-9


def _across(wide: int, similarity: float):
    """Rows (key, side, class, node, print, set) come sorted by key: of each key, every row of side 1 meets every one of side 2. Gives (a, b): links between classes, one for each merge.

    A row's candidates are those within ``wide``; nearest first, their sets are compared until its class and theirs are one.
    """

    def meet(side: np.ndarray, kind: np.ndarray, node: np.ndarray, prints: np.ndarray, sets: np.ndarray) -> list[tuple[int, int]]:
        one, two, out = np.flatnonzero(side == 1), np.flatnonzero(side == 2), []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for at in range(0, len(one) if len(two) else 0, 256):
            own = one[at : at + 256]
            apart = np.zeros((len(own), len(two)), np.uint16)
            for w in range(prints.shape[1]):
                apart += np.bitwise_count(prints[own, w][:, None] ^ prints[two, w][None, :])
            apart[kind[own][:, None] == kind[two][None, :]] = 65535
            for i, row in zip(own.tolist(), apart, strict=True):
                near = np.flatnonzero(row <= wide)
                if not len(near):
                    continue
                x, mine = np.frombuffer(sets[i], "<u4"), int(kind[i])
                for j in two[near[np.argsort(row[near], kind="stable")]].tolist():
                    theirs = int(kind[j])
                    if root(mine) != root(theirs) and alike(x, np.frombuffer(sets[j], "<u4"), similarity):
                        parent[root(mine)] = root(theirs)
                        out.append((int(node[i]), int(node[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if parts and (out := meet(*(np.concatenate(x) for x in zip(*parts, strict=True)))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, side, kind, node = (batch.column(i).to_numpy() for i in range(4))
            prints = np.frombuffer(b"".join(x.as_py() for x in batch.column(4)), "<u8").reshape(batch.num_rows, -1)
            sets = np.empty(batch.num_rows, object)
            sets[:] = batch.column(5).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if keys[a] != last:
                    yield from close()
                    last, parts = keys[a], []
                parts.append((side[a:b], kind[a:b], node[a:b], prints[a:b], sets[a:b]))
        yield from close()

    return run


def similar_links(prints: DataFrame, sets: DataFrame, words: int, similarity: float = 0.8, cap: int = 512, beyond: float = 2.33) -> DataFrame:
    """(a, b): links between the ``node``s of ``prints`` that connect the classes of all pairs that share a key, are near by their wide fingerprints, and are alike by their sets (``node``, ``set``: sorted 32-bit hashes).

    A shard holds the fingerprints that agree on a key of bits; every fingerprint has many keys, long enough that unlike texts seldom share one.
    Near is ``beyond`` standard errors over the distance expected at the similarity (2.33: one pair in a hundred at exactly that similarity is farther). Pairs three standard errors under it
    are taken for alike unseen: one in 700 of those at exactly the similarity is so near, and one in 15,000 of those 0.05 under it. Rows of a shard over ``cap`` are
    searched in parts of about ``cap``, dealt anew in each shard, which joins most of a group, and are candidates all. Nodes with candidates form groups by the
    shards that they share; in each, the rows outside the largest class meet all its rows, in blocks of bounded size, once.
    """
    share = allowed_share(similarity)
    bits = 64 * words
    width, keys = shard_plan(prints.count(), share)
    error = math.sqrt(bits * share * (1 - share))
    tight, wide = int(bits * share - 3 * error), int(bits * share + beyond * error)

    dealt = prints.select(F.lit(0).cast("long").alias("key"), "node", "print").mapInArrow(_deal(words, width, keys, 1), "key long, node long, print binary")
    large = materialise(dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > cap))
    whole, own = F.lit(None).cast("long"), F.col("key")
    if hot := large.count():
        dealt = dealt.join(F.broadcast(large) if hot <= 1 << 16 else large, "key", "left")  # Spark can't tell that they are few, and would shuffle all rows for it
        part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / cap))
        whole, own = F.when(F.col("n").isNotNull(), F.col("key")), F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", part))
    shards = dealt.select(own.alias("key"), whole.alias("whole"), "node", "print").repartition("key").sortWithinPartitions("key")
    found = materialise(shards.mapInArrow(_shard_pairs(tight, wide), "key long, a long, b long"))
    open_rows = found.filter("a = b").select("key", F.col("a").alias("node"))
    good = materialise(found.filter("a <> b").select("a", "b").distinct())
    classes = components(good).select("node", F.col("root").alias("class"))
    # classes that share a shard are in one group: each hangs on the least class of its shards
    named = materialise(open_rows.join(classes, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class")))
    met = named.select("key", "class").distinct()
    tied = met.join(met.groupBy("key").agg(F.min("class").alias("m")), "key").select(F.col("class").alias("a"), F.col("m").alias("b")).distinct()
    groups = components(tied).select(F.col("node").alias("class"), F.col("root").alias("key"))
    rows = named.select("node", "class").distinct().join(groups, "class", "left").withColumn("key", F.coalesce("key", "class"))
    blocks = _open_blocks(rows, 4 * cap)
    if blocks is None:
        return good
    own = prints.select("node", "print").join(blocks.select("node").distinct(), "node", "left_semi").join(sets, "node").dropDuplicates(["node"])
    met = blocks.join(materialise(own), "node").select("key", "side", "class", "node", "print", "set")
    new = met.repartition("key").sortWithinPartitions("key").mapInArrow(_across(wide, similarity), "a long, b long")
    return materialise(good.unionByName(new))


def _open_blocks(rows: DataFrame, block: int) -> DataFrame | None:
    """Blocks (key, side, class, node) in which the rows of a group (key, node, class) outside its largest class meet all its rows; none where every group is one class."""
    rows = materialise(rows)
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("m"))
    groups = sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "class")).alias("main")).filter("n > main.m")
    groups = materialise(groups.select("key", F.col("main.class").alias("main"), F.ceil((F.col("n") - F.col("main.m")) / block).alias("across"), F.ceil(F.col("n") / block).alias("down")))
    if groups.isEmpty():
        return None
    rows = rows.join(groups, "key")

    def side(rows: DataFrame, number: int, own: str, other: str) -> DataFrame:
        rows = rows.select("key", "class", "node", F.pmod(F.xxhash64("node", "key", F.lit(number)), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other))
        return rows.select(F.xxhash64("key", "across", "down").alias("key"), F.lit(number).alias("side"), "class", "node")

    return side(rows.filter("class <> main"), 1, "across", "down").unionByName(side(rows, 2, "down", "across"))


def keep_unlike(docs: DataFrame, id_col: str = "doc_id", size: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """One document of each group of texts that are alike: the one with the smallest id, then the smallest hash of its text; null ids come last.

    Alike are texts whose sets of word shingles have the Jaccard similarity or more; ``64 * words`` bits of SimHash find the pairs to compare. Sets
    are compared by 32-bit hashes. Texts without words are alike.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), text_bytes().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                sets = [shingle_set(t.as_py(), size) for t in b.column(2)]
                prints = [wide_majority(h, words).astype("<u8").tobytes() if len(h) else b"" for h in sets]
                short = [np.unique(h.astype(np.uint32)).astype("<u4").tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.binary()), pa.array(short, pa.binary())], ["__id", "text_hash", "print", "set"])

    kind = rows.schema["__id"].dataType.simpleString()
    each = materialise(rows.mapInArrow(run, f"__id {kind}, text_hash long, print binary, set binary").withColumn("node", F.xxhash64("print", "set")))
    key = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("text_hash").alias("hash"))
    distinct = materialise(each.groupBy("node", "print").agg(F.min(key).alias("k")))  # texts of equal sets are one node
    sets = each.select("node", "set")
    roots = components(similar_links(distinct.filter(F.length("print") > 0).select("node", "print"), sets, words, similarity))
    named = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    kept = with_key(first.select(F.col("id").alias(id_col), "hash", F.lit(None).cast("string").alias("text")), id_col)
    return attach(docs, materialise(kept.select("__key", F.col("hash").alias("__hash"))), id_col).select(docs.columns)


def keep_first(docs: DataFrame, id_col: str = "doc_id", size: int = 3, radius: int = 3) -> DataFrame:
    """One document of each group, the one with the smallest id (then the smallest hash of its text); null ids come last."""
    groups = near_duplicate_groups(docs, id_col, size, radius)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash"))
    first = groups.groupBy("root").agg(F.min(key).alias("k")).select("k.*")
    kept = with_key(first.select(F.col("id").alias(id_col), "hash", F.lit(None).cast("string").alias("text")), id_col)
    return attach(docs, materialise(kept.select("__key", F.col("hash").alias("__hash"))), id_col).select(docs.columns)
