"""Step schedules and samplers: deficit and round-robin schedules, rank and batch arithmetic, stages, learning rates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class DeficitSchedule:
    """Weighted-deficit choice of a tokenizer for each step; the state can be saved and resumed.

    Each step every deficit grows by its weight, the largest (within 1e-12) is taken and loses 1; ties go to the smallest SHA-256 digest of
    'seed:step:id'. Byte weights are divided by bytes per token first.
    """

    weights: list[float]
    seed: int = 0
    bytes_per_token: list[float] | None = None
    step: int = 0
    deficits: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        raw = np.array(self.weights, dtype=float)
        if len(raw) < 2 or (raw <= 0).any():
            raise ValueError("there must be two weights or more, all positive")
        if self.bytes_per_token:
            size = np.array(self.bytes_per_token, dtype=float)
            if size.shape != raw.shape or (size <= 0).any():
                raise ValueError("each weight in bytes needs a positive number of bytes per token")
            raw = raw / size
        self.share = raw / sum(raw.tolist())
        self.deficits = self.deficits or [0.0] * len(raw)

    def take(self, steps: int) -> np.ndarray:
        """The choices of the next `steps` steps."""
        owed, out = np.array(self.deficits, dtype=float), np.empty(steps, dtype=np.int32)
        for k in range(steps):
            owed += self.share
            first = np.flatnonzero(owed > owed.max() - 1e-12)
            if len(first) > 1:
                ties = [hashlib.sha256(f"{self.seed}:{self.step + k}:{i}".encode()).hexdigest() for i in first]
                first = first[[ties.index(min(ties))]]
            out[k] = first[0]
            owed[first[0]] -= 1.0
        self.step, self.deficits = self.step + steps, owed.tolist()
        return out

    def next(self) -> int:
        return int(self.take(1)[0])

    def state(self) -> dict:
        return {"weights": self.weights, "seed": self.seed, "bytes_per_token": self.bytes_per_token, "step": self.step, "deficits": list(self.deficits)}

    def resume(self, state: dict) -> None:
        if (state["weights"], state["seed"], state["bytes_per_token"]) != (self.weights, self.seed, self.bytes_per_token):
            raise ValueError("the state belongs to another schedule")
        self.step, self.deficits = state["step"], list(state["deficits"])


def deficit_schedule(spark: SparkSession, steps: int, schedule: DeficitSchedule) -> DataFrame:
    """(step, tokenizer_id) of the coming steps: a fold over step numbers in one task; each row is two numbers."""
    state = schedule.state()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = DeficitSchedule(state["weights"], state["seed"], state["bytes_per_token"], state["step"], list(state["deficits"]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.take(batch.num_rows))], names=["step", "tokenizer_id"])

    return spark.range(schedule.step, schedule.step + steps, 1, 1).withColumnRenamed("id", "step").mapInArrow(fold, "step bigint, tokenizer_id int")


def round_robin(step: Column, tokenizers: int, seed: int = 0) -> Column:
    return F.pmod(step + seed, F.lit(tokenizers)).cast("int")


def step_context(schedule: DataFrame, sizes: DataFrame, batch: int) -> DataFrame:
    """(step, tokenizer_id, sample): all of a step's samples come from its tokenizer's rows, read on from step to step, again from the start when
    exhausted. sizes: (tokenizer_id, rows). Steps are numbered per tokenizer by ordinals, one row a step."""
    from pyspark.sql import Window as W

    used = F.row_number().over(W.partitionBy("tokenizer_id").orderBy("step")) - 1
    turn = schedule.withColumn("_turn", used).join(sizes, "tokenizer_id").where("rows > 0")
    return turn.select("step", "tokenizer_id", F.col("rows"), F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("k"), "_turn").select("step", "tokenizer_id", F.pmod(F.col("_turn").cast("bigint") * batch + F.col("k"), F.col("rows")).alias("sample"))


def rank_rows(index: Column, rank: int, ranks: int, consumed: int = 0) -> Column:
    """Whether a rank of a strided sampler reads this index, after `consumed` samples were read by all ranks."""
    return (F.pmod(index, F.lit(ranks)) == rank) & (F.floor(index / ranks) >= consumed // ranks)


def batch_place(index: Column, micro: int, ranks: int) -> tuple[Column, Column, Column]:
    """(global batch, rank, place) of an index when batches of micro * ranks are cut in turn."""
    whole = micro * ranks
    return F.floor(index / whole), F.floor(F.pmod(index, F.lit(whole)) / micro).cast("int"), F.pmod(index, F.lit(micro)).cast("int")


def micro_place(index: Column, micro: int, ranks: int) -> tuple[Column, Column, Column]:
    """(micro batch, rank, turn) of an index: micro batches are cut in turn and go to the ranks in turn."""
    batch = F.floor(index / micro)
    return batch, F.pmod(batch, F.lit(ranks)).cast("int"), F.floor(batch / ranks)


def bucket_sampler(items: DataFrame, key: str, order: str, micro: int, ranks: int, consumed: int = 0, seed: int | None = None) -> DataFrame:
    """(key, rank, epoch, place, batch): what each rank still reads in the epoch that `consumed` samples, read by all ranks, lead into.

    Each rank owns a contiguous bucket of the items in order, as many whole micro batches as all ranks can have; the rest is left out. It reads
    its bucket in order, or, with a seed, in the order of a digest of seed, epoch and key. consumed must be whole micro batches of all ranks.
    Items are numbered by ranges, so no task has all of them; null orders come first.
    """
    from millrace.operators.hotkeys import ranked

    total = items.count()
    bucket, active = total // (micro * ranks) * micro, total // (micro * ranks) * micro * ranks
    if not active:
        raise ValueError("there must be a micro batch for each rank")
    epoch, done = consumed // active, consumed % active
    if done % (micro * ranks):
        raise ValueError("consumed samples must be whole micro batches of all ranks")
    rows = ranked(items.select(key, *({order} - {key}), F.lit(0).alias("_all")), "_all", [order, *({key} - {order})]).withColumn("_at", F.col("position") - 1)
    rows = rows.where(F.col("_at") < active).withColumn("rank", F.floor(F.col("_at") / bucket).cast("int")).withColumn("place", F.pmod("_at", F.lit(bucket)))
    if seed is not None:
        turn = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")), 256)
        rows = ranked(rows.select(key, "rank", turn.alias("_turn")), "rank", ["_turn", key]).withColumn("place", F.col("position") - 1)
    left = rows.where(F.col("place") >= done // ranks)
    return left.select(key, "rank", F.lit(epoch).cast("bigint").alias("epoch"), F.col("place").cast("bigint").alias("place"), F.floor(F.col("place") / micro).alias("batch"))


def cyclic_place(index: Column, total: int, rank: int, ranks: int, micro: int) -> tuple[Column, Column]:
    """(epoch, sample) of a rank's index-th row when each rank owns a contiguous bucket and starts over at its end."""
    bucket = total // (micro * ranks) * micro
    if bucket <= 0:
        raise ValueError("there must be a micro batch for each rank")
    return F.floor(index / bucket), F.pmod(index, F.lit(bucket)) + rank * bucket


def domain_samples(items: DataFrame, key: str, domain: str, weights: dict[str, float], batch: int, micro: int, ranks: int, seed: int) -> DataFrame:
    """(key, domain, step, rank, microbatch, place): batches in which each domain has its part, as domain_batch gives it.

    A domain's items are read on in the order of a digest of seed and key; a batch has its domains one after the other, in order of name, and is cut into
    the ranks' parts and their micro batches. Batches end with the first that a domain has too few items for. weights has a row a domain;
    items of other domains aren't read.
    """
    from millrace.operators.hotkeys import ranked

    if batch % (micro * ranks):
        raise ValueError("a batch must be whole micro batches of all ranks")
    names = sorted(d for d, w in weights.items() if w > 0)
    counts = domain_batch([weights[d] for d in names], batch)
    spark = items.sparkSession
    sizes = spark.createDataFrame([(d, n, sum(counts[:k])) for k, (d, n) in enumerate(zip(names, counts))], "_d string, _size int, _first int")
    rows = items.select(key, domain, F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256).alias("_turn")).join(F.broadcast(sizes), F.col(domain) == F.col("_d"))
    rows = ranked(rows, domain, ["_turn", key]).withColumn("_at", F.col("position") - 1)
    full = rows.groupBy(domain).agg(F.floor(F.max("key_rows") / F.max("_size")).alias("n"))  # a row a domain
    steps = full.agg(F.when(F.count("*") == len(names), F.min("n")).otherwise(0).alias("_steps"))  # one row
    place = F.col("_first") + F.pmod("_at", F.col("_size"))
    rows = rows.withColumn("step", F.floor(F.col("_at") / F.col("_size"))).join(F.broadcast(steps)).where(F.col("step") < F.col("_steps")).withColumn("place", place.cast("int"))
    own = batch // ranks
    return rows.select(key, domain, "step", F.floor(F.col("place") / own).cast("int").alias("rank"), F.floor(F.pmod("place", F.lit(own)) / micro).cast("int").alias("microbatch"), "place")


def domain_batch(weights: list[float], batch: int) -> list[int]:
    """Samples of each domain in a batch: round half to even, at least 1, then one more for the largest shortfalls or one less for the largest surplus
    until exact; ties to the lowest domain."""
    total = sum(weights)
    if len(weights) > batch:
        raise ValueError("the batch is smaller than the number of domains")
    exact = [w / total * batch for w in weights]
    out = [max(1, round(x)) for x in exact]
    while sum(out) != batch:
        up = sum(out) < batch
        order = sorted(range(len(out)), key=lambda d: (out[d] - exact[d] if up else exact[d] - out[d], d))
        best = next(d for d in order if up or out[d] > 1)
        out[best] += 1 if up else -1
    return out


def learning_rate(step: Column, warmup: int, hold: int, decay: int, style: str = "cosine", floor: float = 0.1, warmup_style: str = "linear") -> Column:
    """Factor of the learning rate: warm-up (up to and with its last step), constant, decay, floor."""
    import math

    start = warmup + hold
    part = (step - start) / decay if decay else F.lit(1.0)
    falls = {"linear": floor + (1 - floor) * (1 - part), "cosine": floor + (1 - floor) * (1 + F.cos(part * math.pi)) / 2, "1-sqrt": floor + (1 - floor) * (1 - F.sqrt(part))}
    up = step / warmup if warmup and warmup_style == "linear" else F.lit(1.0)
    return F.when(step <= warmup, up).when(step <= start, 1.0).when(step < start + decay, falls[style]).otherwise(floor)


def latest_stage(steps: DataFrame, stages: DataFrame) -> DataFrame:
    """steps with the stage in force: the one with the greatest start at or before the step; steps before the first stage drop out.

    stages (stage, start) is small: its intervals are made by one window and joined by range.
    """
    from pyspark.sql import Window as W

    from millrace.operators.packing import interval_join

    w = W.orderBy("start")
    ends = stages.withColumn("r_to", F.lead("start").over(w)).select("stage", F.col("start").alias("r_from"), F.coalesce("r_to", F.lit(2**31)).alias("r_to"))
    top = F.col("r_to")
    # an open end is cut at the last step, so that buckets are few
    most = steps.agg((F.max("step") + 1).alias("_most"))
    ends = ends.crossJoin(F.broadcast(most)).withColumn("r_to", F.least(top, F.greatest(F.col("_most"), F.col("r_from")))).drop("_most")  # one row
    points = steps.withColumn("l_from", F.col("step")).withColumn("l_to", F.col("step") + 1)
    return interval_join(points, ends, 1024).drop("l_from", "l_to", "r_from", "r_to")
