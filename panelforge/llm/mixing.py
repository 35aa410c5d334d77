"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle, served up to ``repeats`` times over. A
document's virtual start is the number of words its source has served before it, divided by the
source's weight; its virtual finish adds its own words. All servings are range-sorted by virtual finish: in that
order all sources progress in proportion to their weights, and a source that has run through its repeats drops out
while the others share on by weight. The sorted stream carries, as prefix sums, the words and the weights of the sources
that have run dry, so each serving knows how many words have been served by its finish: the stream is truncated at
the virtual time at which that reaches the budget. The documents that are in service at that time count with the words
served by then, so each source's taken words are within one word of its target.

Defined results: null and empty texts have size 0 and nothing is taken of them; a null source is a
source of its own, after all others; repeated rows are documents of their own; null ids are kept.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, materialise, ordered_positions, with_key

#: Fixed: words are runs of anything but space and \\x09-\\x0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def source_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(``source``, ``source_size``, ``weight``) from (source, size): weights repeat over sources by code point, null last. A range sort numbers the sources, however many there are."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ordered_positions(totals, [F.col("source").asc_nulls_last()])
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("position") % len(cycle) + 1).cast("int")).cast("double")).drop("position")


def queues(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each source's documents in their shuffled order: ``id``, ``source``, ``size``, ``__key``, ``__hash``, ``start`` (words its source serves before it in a pass), ``source_size``, ``weight``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = with_key(docs, id_col).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), "__key", "__hash")
    mixed = F.conv(F.substring(F.md5(F.concat(F.col("__key"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")  # 60 bits, the same in any engine
    rows = materialise(rows.withColumn("__mixed", mixed))
    n = rows.count()
    bits = max(1, math.ceil(math.log2(max(2.0, n / max(256.0, math.sqrt(n))))))
    rows = rows.withColumn("__bucket", F.shiftright("__mixed", 60 - bits))
    # sums within buckets of the shuffled order, then over buckets: a hot source is dealt over all its buckets
    buckets = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__words"))
    earlier = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("__before", F.coalesce(F.sum("__words").over(earlier), F.lit(0))).drop("__words")
    buckets = buckets.withColumnsRenamed({"source": "__s", "__bucket": "__b"})
    inside = W.partitionBy("source", "__bucket").orderBy("__mixed", "__key", "__hash", "size").rowsBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = found.join(buckets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    found = found.withColumn("start", F.col("__before") + F.col("__inside")).drop("__s", "__b", "__bucket", "__before", "__inside", "__mixed")
    weights = source_weights(rows, cycle).withColumnRenamed("source", "__s")
    return found.join(weights, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def stream(queued: DataFrame, repeats: int = 3, budget: float = 1.0) -> tuple[DataFrame, float]:
    """The mix from ``queues`` and the virtual time at which it is cut.

    One row for each serving: the columns of ``queued``, ``copy``, ``virtual_start``, ``virtual_finish``, ``words`` (served by the cut) and
    ``position`` in the global order of virtual finish. ``budget`` is a share of all words.
    """
    each = queued.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    at = F.col("copy") * F.col("source_size") + F.col("start")
    each = each.withColumn("virtual_start", at / F.col("weight")).withColumn("virtual_finish", (at + F.col("size")) / F.col("weight"))
    dry = at + F.col("size") == F.col("source_size") * repeats  # the last serving of its source
    each = each.withColumn("__dry", F.when(dry, F.col("source_size") * repeats).otherwise(0).cast("long")).withColumn("__gone", F.when(dry, F.col("weight")).otherwise(0.0))
    order = ["virtual_finish", F.col("source").asc_nulls_last(), F.col("id").asc_nulls_last(), "__key", "__hash", "copy", "start"]
    placed = ordered_positions(each, order, ["__dry", "__gone"])
    sources = queued.filter("size > 0").groupBy("source").agg(F.first("source_size").alias("n"), F.first("weight").alias("w"))
    words, weight = sources.agg(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(float(budget)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    left = F.lit(float(weight)) - F.col("before___gone")  # weights of the sources that are still served
    served = F.col("before___dry") + F.col("virtual_finish") * left
    reached = placed.filter(served >= F.lit(float(words))).agg(F.min(F.struct("position", ((F.lit(float(words)) - F.col("before___dry")) / left).alias("cut"))).alias("m")).first()["m"]
    cut = float(reached["cut"]) if reached is not None else math.inf
    return placed.withColumn("words", _served(at, repeats, cut)).filter("words > 0").drop("__dry", "__gone", "before___dry", "before___gone"), cut


def _target(cut: float, repeats: int) -> Column:
    return F.least(F.col("weight") * F.lit(cut), F.col("source_size") * F.lit(float(repeats)))


def _served(at: Column, repeats: int, cut: float) -> Column:
    """Words of a serving that starts after ``at`` words of its source, by the virtual time ``cut``."""
    return F.least(F.greatest(F.round(_target(cut, repeats)).cast("long") - at, F.lit(0)), F.col("size"))


def schedule(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), repeats: int = 3, budget: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per document: id, ``source``, ``size``, ``source_size``, ``weight``, ``target``, ``start`` (words its source serves before it in a pass), ``taken``, ``copies``.

    ``taken`` sums the document's servings in the truncated stream. ``copies`` counts those that serve at least half of the document: whole documents
    for writers that don't cut texts.
    """
    queued = materialise(queues(docs, cycle, seed, id_col, source_col))
    mix, cut = stream(queued, repeats, budget)
    own = ["id", "source", "size", "__key", "__hash", "start", "source_size", "weight"]  # rows of a source with words differ in where they start
    served = mix.select(*own, "words", F.when(F.col("words") * 2 >= F.col("size"), 1).otherwise(0).alias("copies"))
    none = queued.filter("size > 0").select(*own, F.lit(0).cast("long").alias("words"), F.lit(0).alias("copies"))
    found = served.unionByName(none).groupBy(*own).agg(F.sum("words").alias("taken"), F.sum("copies").cast("int").alias("copies"))
    found = found.unionByName(queued.filter("size = 0").select(*own, F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies")))
    return found.withColumn("target", _target(cut, repeats)).withColumnRenamed("id", id_col)


def mixed_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), repeats: int = 3, budget: float = 1.0, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, each as often as it is served; same columns."""
    planned = schedule(docs, cycle, repeats, budget, seed, id_col)
    taken = planned.filter("copies > 0").groupBy("__key", "__hash").agg(F.sum("copies").alias("__copies"))
    rows = attach(docs, materialise(taken), id_col)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)
