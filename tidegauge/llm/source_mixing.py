"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Every source gets a target number of words from its weight, no more than
``max_repeats`` times what it holds. The whole mix is then cut into blocks of
``block`` words, and the blocks are apportioned among sources by highest
quotients target/(2k+1). A source's quota is apportioned in the same way among
its shards, by their words; so each shard has an integer quota of blocks, which
it picks by seeded systematic selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shard, about: documents of a source go to shards, so that none is ranked in one task.
SHARD_WORDS = 1 << 20
BLOCK = 16
#: Rows of a plan, some 100 bytes each, that may be broadcast.
FEW = 50_000


def _digits(hexadecimal: str | Column, start: int, n: int) -> Column:
    """A number from some digits of a column of hexadecimal text."""
    return F.conv(F.substring(hexadecimal, start, n), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, text key, seeded MD5): size is the number of words, 0 for a null text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("_t"), draw.alias("_m"))


def weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: ``weights`` repeat over sources by code point, null last.

    ``sources`` has one row a source, so this single ranking is as small as
    their number.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return sources.withColumn("weight", pick)


def targeted(sources: DataFrame, share: float, max_repeats: int) -> DataFrame:
    """Adds ``target``: weight times one level, but at most max_repeats * source_size.

    The level makes all targets sum to share * total size. Sources whose
    capacity per weight is least fill up first; the level is the first that the
    remaining sources can carry.
    """
    cap = (F.col("source_size") * max_repeats).cast("double")
    everything, by_room = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy("room", F.col("source").asc_nulls_last())
    s = sources.withColumn("cap", cap).withColumn("room", F.col("cap") / F.col("weight"))
    s = s.withColumn("goal", F.sum("source_size").over(everything) * share)
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("goal") - F.col("full")) / F.col("left")
    s = s.withColumn("level", level).withColumn("nth", F.row_number().over(by_room))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("room"), F.col("nth"))).over(everything))
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).drop("cap", "room", "goal", "full", "left", "level", "nth")


def seated(rows: DataFrame, group: list[str], key: str, weight: str, total: str) -> DataFrame:
    """Adds ``won``: of ``total`` seats a group, how many each key gets by the highest quotients weight/(2k+1).

    Ties go to the key that comes first, null last. With n keys, dividing all
    weights by the same number seats at most n/2 too many or too few; so no key
    is further than n/2 times its share of the total, and one for rounding,
    from its rounded share. Only these quotients, a few a key, are ranked.
    """
    all_ = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    share = F.when(F.sum(weight).over(all_) > 0, F.col(weight) * F.col(total) / F.sum(weight).over(all_)).otherwise(F.lit(0.0))
    s = rows.withColumn("_share", share).withColumn("_n", F.count(F.lit(1)).over(all_))
    s = s.withColumn("_off", F.ceil(F.col("_share") * F.col("_n") / (2 * F.greatest(F.col(total), F.lit(1)))) + 1).withColumn("_near", F.round("_share"))
    s = s.withColumn("_base", F.greatest(F.lit(0), F.col("_near") - F.col("_off")).cast("long"))
    s = s.withColumn("_open", F.col(total) - F.sum("_base").over(all_))
    seats = s.withColumn("_k", F.explode(F.sequence("_base", (F.col("_near") + F.col("_off")).cast("long")))).withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(all_.orderBy(F.col("_quotient").desc(), F.col(key).asc_nulls_last(), "_k"))
    seats = seats.withColumn("_won", ((rank <= F.col("_open")) & (F.col("_quotient") > 0)).cast("long"))
    return seats.groupBy(*rows.columns, "_base").agg(F.sum("_won").alias("_won")).select(*rows.columns, (F.col("_base") + F.col("_won")).alias("won"))


def apportioned(sources: DataFrame, block: int, max_repeats: int) -> DataFrame:
    """Adds ``quota``: whole blocks by Sainte-Laguë's highest quotients."""
    s = sources.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("total", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block).cast("long"))
    quota = F.least("won", F.col("blocks") * max_repeats).cast("long")
    return seated(s, [], "source", "target", "total").select("source", "source_size", "weight", "target", "blocks", quota.alias("quota"))


def picked(upto: Column, n: Column, r: Column, phase: Column) -> Column:
    """How many of the blocks 0..upto-1 are among the r of n that are picked, evenly spread from a seeded phase."""
    return F.when(n > 0, F.floor((upto * r + phase) / n) - F.floor(phase / n)).otherwise(F.lit(0)).cast("long")


def few(plan: DataFrame) -> DataFrame:
    """A plan, to be broadcast if it is small enough."""
    return F.broadcast(plan) if plan.limit(FEW + 1).count() <= FEW else plan


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, block: int = BLOCK, seed: int = 17, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, weight, target, quota, shard, shard_quota, taken, text_key (xxhash64 of the text).

    ``quota`` and ``shard_quota`` are blocks of the source and of the document's
    shard of it. ``taken`` is how many words the mix takes from the document,
    repeats counted: never over max_repeats times its size. Null or empty texts
    have size 0 and nothing is taken from them; a null source is one more
    source, the last. Repeated rows count each. Reruns give the same numbers.
    """
    d = materialize(sized(docs, seed), "sizes")
    sources = d.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = apportioned(targeted(weighted(sources, weights), share, max_repeats), block, max_repeats)
    plan = plan.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    plan = materialize(plan.withColumnRenamed("source", "of").drop("blocks"), "plan", free=False)
    d = d.join(few(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    d = d.withColumn("h", _digits("_m", 1, 15)).withColumn("shard", _digits("_m", 16, 8) % F.col("shards"))
    part = d.groupBy("source", "shard", "quota").agg(F.sum("size").cast("long").alias("shard_size"))
    part = seated(part, ["source"], "shard", "shard_size", "quota").withColumn("blocks", F.ceil(F.col("shard_size") / block))
    part = part.select(F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), "blocks", F.least("won", F.col("blocks") * max_repeats).cast("long").alias("shard_quota"))
    part = materialize(part, "shards", free=False)
    here = W.partitionBy("source", "shard").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(here), F.lit(0)))
    d = d.join(few(part), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")))
    n, quota, block_ = F.col("blocks"), F.col("shard_quota"), F.lit(block)
    d = d.withColumn("end", F.col("start") + F.col("size"))
    d = d.withColumn("whole", F.when(n > 0, F.floor(quota / n)).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.when(n > 0, quota % n).otherwise(F.lit(0)))
    phase = F.when(n > 0, _digits(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), 1, 15) % n).otherwise(F.lit(0))

    def words_before(at: Column) -> Column:
        """Words of the picked blocks that lie before the position ``at``."""
        b = F.floor(at / block_)
        full = picked(b, n, F.col("rest"), phase)
        return full * block + (at - b * block) * (picked(b + 1, n, F.col("rest"), phase) - full)

    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size") + words_before(F.col("end")) - words_before(F.col("start"))).otherwise(F.lit(0))
    return d.select("doc_id", "source", "size", "source_size", "weight", "target", "quota", "shard", "shard_quota", taken.cast("long").alias("taken"), F.col("_t").alias("text_key"))
