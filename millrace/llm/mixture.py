"""Mixtures with a target share per source: Sainte-Laguë quotas of equal blocks for every shard, then seeded block selection.

The mixture is as large as the collection and consists of SEATS blocks of equal size. Blocks go to the sources by the highest quotients
weight / (2 blocks + 1); every SEATS / SHARDS blocks in that order make a shard, so each shard has a whole quota for each source and shares
near the targets of its own. A source's records stand in seeded order, one after the other, and again from the start as often as max_repeats
allows; its k-th block is the k-th stretch of a block's size of that row, and a record is used where it begins, if it ends within the quota.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import byte_length, strip
from millrace.operators.hotkeys import spread_join
from millrace.operators.prefix import hex_bucket, running_before
from millrace.session import stored

SEATS = 10_000  # blocks in the whole mixture
SHARDS = 10


def sized_records(records: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(key, source, bytes, turn): each record once; bytes is the UTF-8 length of the trimmed text, 0 for null; turn, a digest of seed and key, orders a source.

    Records with a null key count as one record; columns of other names, whatever they are called, are ignored.
    """
    rows = records.select(records[key].alias(key), records[source].alias("source"), F.coalesce(byte_length(strip(records[text])), F.lit(0)).cast("bigint").alias("bytes"))
    once = rows.groupBy(key).agg(F.first("source").alias("source"), F.first("bytes").alias("bytes"))
    return once.select(key, "source", "bytes", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("turn"))


def capacities(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, bytes, total, capped) of every target source, from (source, bytes), one row or more a source.

    bytes is the source's size, total that of all sources; capped if bytes * max_repeats stays below target_weight * total.
    A target without records has 0 bytes. Null weights are taken for 0, null repeats for 1.
    """
    sizes = sizes.groupBy("source").agg(F.sum("bytes").alias("bytes"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    named = targets.where("source IS NOT NULL").select("source", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    out = named.join(sizes, "source", "left").crossJoin(F.broadcast(total))  # one row
    have = F.coalesce("bytes", F.lit(0))
    return out.select("source", "target_weight", "max_repeats", have.alias("bytes"), "total", (have * F.col("max_repeats") < F.col("target_weight") * F.col("total")).alias("capped"))


def seats_won(sources: DataFrame, seats: int = SEATS, shards: int = SHARDS, weight: str = "target_weight") -> DataFrame:
    """(source, seat, shard), `seats` rows if any weight is positive: a source's seats are numbered from 0, ties go to the smaller source name, then seat.

    A source has at most share * (seats + sources / 2) + 1 / 2 seats in any such ranking, so no more quotients than that are ranked.
    """
    w = W.partitionBy()
    shared = sources.where(F.col(weight) > 0).select("source", weight).withColumn("_n", F.count("*").over(w)).withColumn("_share", F.col(weight) / F.sum(weight).over(w))
    most = F.floor(F.col("_share") * (seats + F.col("_n") / 2) + 1).cast("int")
    tries = shared.select("source", weight, F.explode(F.sequence(F.lit(0), most)).alias("seat"))
    ranked = tries.withColumn("_rank", F.row_number().over(W.orderBy(F.desc(F.col(weight) / (2 * F.col("seat") + 1)), "source", "seat")))
    return ranked.where(F.col("_rank") <= seats).select("source", "seat", F.floor((F.col("_rank") - 1) * shards / seats).cast("int").alias("shard"))


def sainte_lague(sources: DataFrame, seats: int = SEATS, weight: str = "target_weight") -> DataFrame:
    """sources with quota: the number of their seats; quotas add up to `seats` if any weight is positive."""
    quotas = seats_won(sources, seats, 1, weight).groupBy("source").agg(F.count("*").alias("quota"))
    return sources.join(quotas, "source", "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def shard_quotas(targets: DataFrame, seats: int = SEATS, shards: int = SHARDS) -> DataFrame:
    """(shard, source, quota): blocks of every source with a seat in each shard; a shard has seats / shards blocks."""
    return seats_won(targets.where("source IS NOT NULL"), seats, shards).groupBy("shard", "source").agg(F.count("*").alias("quota"))


def unfilled(plan: DataFrame, seats: int = SEATS) -> DataFrame:
    """Sources of a plan (capacities with quota) that cannot fill their share of the mixture.

    A quota is at least the share of the seats less half a seat and half a seat for each source; sources whose capacity, in blocks, lies below the
    quota and that margin are looked at, and those stay whose capacity in bytes is below the share itself.
    """
    sources = F.count(F.when(F.col("target_weight") > 0, 1)).over(W.partitionBy())
    near = plan.withColumn("_margin", sources / 2 + 1).where((F.col("quota") + F.col("_margin")) * F.col("total") > F.col("bytes").cast("double") * F.col("max_repeats") * seats)
    return near.where("capped").drop("_margin")


def mixture_plan(sizes: DataFrame, targets: DataFrame, seats: int = SEATS) -> DataFrame:
    """capacities of each source with its quota of blocks and the bytes wanted, quota / seats of the total."""
    plan = sainte_lague(capacities(sizes, targets), seats)
    return plan.withColumn("wanted", F.expr(f"CAST(quota AS DECIMAL(18,0)) * CAST(total AS DECIMAL(19,0)) div {seats}").cast("bigint"))


def mixture(records: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, seats: int = SEATS, shards: int = SHARDS) -> DataFrame:
    """(key, source, bytes, copy, shard) of every use of a record, copy from 0 up to max_repeats - 1.

    The mixture is as large as the whole collection. Records of
    no target source, of a null source, and with no bytes (null, empty and blank texts) are not used; records written again count once.
    """
    sized = stored(sized_records(records, key, text, source, seed), "sized")
    sizes = stored(sized.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "sizes")
    plan = mixture_plan(sizes.select("source", "bytes"), targets, seats).select("source", F.col("bytes").alias("have"), "total", "max_repeats", "wanted")
    rows = running_before(sized.where("bytes > 0 AND source IS NOT NULL"), ["source"], hex_bucket("turn"), ["turn", key], "bytes", "start")
    rows = spread_join(rows.select(key, "source", "bytes", "start"), plan.where("have > 0"), ["source"], sizes.where("source IS NOT NULL").select("source", "n"), deal=[key])
    uses = F.least(F.floor((F.col("wanted") - F.col("start") - F.col("bytes")) / F.col("have")) + 1, F.col("max_repeats").cast("bigint"))
    rows = rows.withColumn("uses", uses).where("uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int"))))
    rows = rows.withColumn("seat", F.expr(f"CAST(copy * have + start AS DECIMAL(19,0)) * {seats} div CAST(total AS DECIMAL(19,0))").cast("int"))
    won = F.broadcast(seats_won(targets.where("source IS NOT NULL"), seats, shards))  # `seats` rows
    return rows.join(won, ["source", "seat"]).select(key, "source", "bytes", "copy", "shard")


def mixture_shares(records: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_weight, max_repeats, quota, used_records, used_bytes, share, target_met) of every target source."""
    sized = sized_records(records, **{k: v for k, v in options.items() if k in ("key", "text", "source", "seed")})
    plan = mixture_plan(sized.groupBy("source").agg(F.sum("bytes").alias("bytes")), targets, options.get("seats", SEATS))
    used = mixture(records, targets, **options).groupBy("source").agg(F.count(F.when(F.col("copy") == 0, 1)).alias("used_records"), F.sum("bytes").alias("used_bytes"))
    out = plan.join(used, "source", "left").select("source", "target_weight", "max_repeats", "quota", F.coalesce("used_records", F.lit(0)).alias("used_records"), F.coalesce("used_bytes", F.lit(0)).alias("used_bytes"), "capped")
    share = F.try_divide(F.col("used_bytes").cast("double"), F.sum("used_bytes").over(W.partitionBy()))
    return out.select("source", "target_weight", "max_repeats", "quota", "used_records", "used_bytes", F.round(share, 9).alias("share"), (~F.col("capped")).alias("target_met"))
