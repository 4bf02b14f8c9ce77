"""Token streams cut into training sequences: packing, sample indices, chunks, positions and masks.

Every index is a closed form over exclusive running sums: a document knows from its start and length which sequences it touches, so
sequences come from exploding short ranges of numbers; there is no range join, and tokens themselves are only sliced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.operators.prefix import running_before


def token_offsets(df: DataFrame, group: list[str], order: str, tokens: str, extra: int = 1) -> DataFrame:
    """df with start and length of each document in its group's stream; extra counts the special tokens added to each. Null counts are 0."""
    sized = df.withColumn("length", F.coalesce(F.col(tokens), F.lit(0)).cast("bigint") + extra)
    return running_before(sized, group, order, [order], "length", "start")


def packed_fragments(offsets: DataFrame, group: list[str], key: str, width: int) -> DataFrame:
    """(group, seq_id, key, doc_offset, length): what each document gives to each full sequence of `width` tokens.

    Sequences never span groups; the incomplete one at the end of a group is dropped. Documents without tokens give nothing.
    """
    ends = offsets.groupBy(*group).agg((F.floor(F.sum("length") / width)).alias("_full")).select(*[F.col(g).alias(f"_e{i}") for i, g in enumerate(group)], "_full")
    seqs = offsets.where("length > 0").select(*group, key, "start", "length", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("length") - 1) / width))).alias("seq_id"))
    low = F.greatest(F.col("start"), F.col("seq_id") * width)
    high = F.least(F.col("start") + F.col("length"), (F.col("seq_id") + 1) * width)
    meets = F.lit(True)
    for i, g in enumerate(group):
        meets = meets & F.col(g).eqNullSafe(F.col(f"_e{i}"))
    return seqs.join(ends, meets).where(F.col("seq_id") < F.col("_full")).select(*group, "seq_id", key, (low - F.col("start")).alias("doc_offset"), (high - low).alias("length"))


def packed_sequences(fragments: DataFrame, tokens: DataFrame, group: list[str], key: str, ids: str = "ids") -> DataFrame:
    """(group, seq_id, input_ids): the fragments' token slices in order. tokens: (key, ids) with the special tokens already added."""
    cut = fragments.join(tokens, key).withColumn("part", F.slice(ids, (F.col("doc_offset") + 1).cast("int"), F.col("length").cast("int")))
    return cut.groupBy(*group, "seq_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, "doc_offset", "part"))), lambda s: s["part"])).alias("input_ids"))


def sample_index(offsets: DataFrame, key: str, length: int) -> DataFrame:
    """(sample, key, offset): the document and offset in which each sample of `length` + 1 tokens (one token of overlap) starts.

    Only samples that are complete come out. Documents without tokens start none.
    """
    total = offsets.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("_total"))
    first = F.ceil(F.col("start") / length)
    last = F.floor((F.col("start") + F.col("length") - 1) / length)
    rows = offsets.where("length > 0").where(first <= last).select(key, "start", F.explode(F.sequence(first, last)).alias("sample"))
    return rows.crossJoin(F.broadcast(total)).where((F.col("sample") + 1) * length < F.col("_total")).select("sample", key, (F.col("sample") * length - F.col("start")).alias("offset"))  # total is one row


def sample_fragments(offsets: DataFrame, key: str, length: int) -> DataFrame:
    """(sample, key, offset, take): every document slice of every complete sample of `length` + 1 tokens."""
    total = offsets.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("_total"))
    first = F.greatest(F.ceil((F.col("start") - length) / length), F.lit(0))
    last = F.floor((F.col("start") + F.col("length") - 1) / length)
    rows = offsets.where("length > 0").select(key, "start", "length", F.explode(F.sequence(first, last)).alias("sample"))
    low = F.greatest(F.col("start"), F.col("sample") * length)
    high = F.least(F.col("start") + F.col("length"), (F.col("sample") + 1) * length + 1)
    return rows.crossJoin(F.broadcast(total)).where((F.col("sample") + 1) * length < F.col("_total")).where(low < high).select("sample", key, (low - F.col("start")).alias("offset"), (high - low).alias("take"))  # total is one row


def grouped_chunks(tokens: Column, length: int, strict: bool = False) -> Column:
    """Chunks of `length` + 1 tokens with one of overlap that a batch of that many tokens gives; strict leaves the last out, as one
    published implementation does."""
    return F.when(tokens >= length + 1, F.floor((tokens - 1) / length) - (1 if strict else 0)).otherwise(0)


def epochs_needed(samples: Column, length: int, per_epoch: Column, extra: int = 1) -> Column:
    """Least number of epochs that hold so many samples; null for an epoch without tokens."""
    return F.when(per_epoch > 0, F.ceil((samples * length + extra) / per_epoch))


def interval_join(left: DataFrame, right: DataFrame, width: int, l_from: str = "l_from", l_to: str = "l_to", r_from: str = "r_from", r_to: str = "r_to") -> DataFrame:
    """All pairs of half-open intervals that overlap: max(from) < min(to). Column names of the two sides must differ.

    Both sides are exploded into the buckets they touch and equi-joined; a pair is kept in the first bucket both touch, so none comes
    twice. width should be near the typical interval. Empty and null intervals meet nothing.
    """
    bucketed = lambda df, a, b, n: df.where(F.col(a) < F.col(b)).withColumn(n, F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))
    joined = bucketed(left, l_from, l_to, "_x").join(bucketed(right, r_from, r_to, "_y"), F.col("_x") == F.col("_y"))
    low, high = F.greatest(F.col(l_from), F.col(r_from)), F.least(F.col(l_to), F.col(r_to))
    return joined.where((low < high) & (F.floor(low / width) == F.col("_x"))).drop("_x", "_y")


def exploded_positions(df: DataFrame, key: str, ids: str, eos: int) -> DataFrame:
    """(key, i, token_id, position, label_id, label_mask) of every token but the last of each sequence.

    Positions restart at 0 after each eos; label is the next token; the mask is false where the label opens a document. The window holds
    one sequence, whose length is bounded by its packing. Null and empty sequences give nothing.
    """
    rows = df.select(key, F.posexplode(ids).alias("i", "token_id"))
    w = W.partitionBy(key).orderBy("i")
    opened = F.coalesce(F.lag("token_id").over(w) == eos, F.lit(True))
    start = F.last(F.when(F.col("_open"), F.col("i")), ignorenulls=True).over(w)
    rows = rows.withColumn("_open", opened).withColumn("position", F.col("i") - start)
    rows = rows.withColumn("label_id", F.lead("token_id").over(w)).withColumn("label_mask", F.lead("position").over(w) != 0)
    return rows.where("label_id IS NOT NULL").select(key, "i", "token_id", "position", "label_id", "label_mask")


def left_padded_positions(ids: Column, pad: int) -> Column:
    """0 up to the last token of the leading padding, then 0, 1, 2, ...; null for null."""
    first = F.array_position(F.transform(ids, lambda x: x != pad), True)  # 0 if all is padding
    lead = F.when(first > 0, first - 1).otherwise(F.size(ids)).cast("int")
    rest = F.size(ids) - lead
    counted = F.when(rest > 0, F.sequence(F.lit(0), rest - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(ids.isNotNull(), F.concat(F.array_repeat(F.lit(0), lead), counted))


def supervised(df: DataFrame, prompt: str, completion: str, length: int) -> DataFrame:
    """df (token counts of prompt and completion) with tokens, labels and padding of each example; rows without a label drop out.

    prompt + completion + eos is cut to length + 1; labels are the shifted tokens after the prompt; the rest of `length` is right padding.
    Null counts are 0.
    """
    p, c = F.coalesce(F.col(prompt), F.lit(0)), F.coalesce(F.col(completion), F.lit(0))
    tokens = F.least(p + c + 1, F.lit(length + 1))
    out = df.withColumn("tokens", tokens).withColumn("labels", F.greatest(F.col("tokens") - F.greatest(p, F.lit(1)), F.lit(0)))
    return out.where("labels > 0").withColumn("padding", F.lit(length) - (F.col("tokens") - 1))


def scored_chunks(df: DataFrame, key: list[str], tokens: str, block: int) -> DataFrame:
    """(key, chunk_start, chunk_end): chunks of at most `block` tokens that overlap by one, so each token after the first is scored once.

    A document of fewer than 2 tokens has none.
    """
    if block < 2:
        raise ValueError("block must be 2 or more")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(tokens) - 2, F.lit(block - 1).cast("bigint")))
    return df.where(F.col(tokens) >= 2).select(*key, tokens, starts.alias("chunk_start")).select(*key, "chunk_start", F.least(F.col("chunk_start") + block, F.col(tokens)).alias("chunk_end"))


def encoded_length(tokens: Column, has_bos: bool) -> Column:
    """Length of a document with its special tokens: eos tokens eos, or bos tokens (the published rule uses eos at both ends unless there is a bos)."""
    return tokens + (1 if has_bos else 2)


def encoded_document(ids: Column, bos: int | None = None, eos: int | None = None) -> Column:
    """A document's ids as they are scored: between two eos if there is an eos, else after a bos if there is one, else bare; null for null."""
    if eos is not None:
        return F.concat(F.array(F.lit(eos)), ids, F.array(F.lit(eos)))
    return ids if bos is None else F.concat(F.array(F.lit(bos)), ids)


def grouped_fragments(offsets: DataFrame, group: list[str], key: str, length: int, strict: bool = False) -> DataFrame:
    """(group, chunk, key, doc_offset, length): what each document gives to each chunk of `length` + 1 tokens, with one of overlap, of its group's stream.

    A group has grouped_chunks(its tokens) chunks; documents without tokens give nothing.
    """
    ends = offsets.groupBy(*group).agg(grouped_chunks(F.sum("length"), length, strict).alias("_chunks")).select(*[F.col(g).alias(f"_e{i}") for i, g in enumerate(group)], "_chunks")
    first = F.greatest(F.ceil((F.col("start") - length) / length), F.lit(0))
    last = F.floor((F.col("start") + F.col("length") - 1) / length)
    rows = offsets.where("length > 0").select(*group, key, "start", "length", F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.col("start"), F.col("chunk") * length)
    high = F.least(F.col("start") + F.col("length"), (F.col("chunk") + 1) * length + 1)
    meets = F.lit(True)
    for i, g in enumerate(group):
        meets = meets & F.col(g).eqNullSafe(F.col(f"_e{i}"))
    return rows.join(ends, meets).where((F.col("chunk") < F.col("_chunks")) & (low < high)).select(*group, "chunk", key, (low - F.col("start")).alias("doc_offset"), (high - low).alias("length"))


def collated(ids: Column, eos: int) -> Column:
    """A struct of input_ids, label_ids, position_ids and label_mask of a packed sequence, in the row: positions restart after each eos, a label that
    opens a document is masked. Empty arrays for fewer than 2 tokens and for null. Select it by inline(array(...)), which evaluates it once."""
    none = F.array().cast("array<int>")
    opens = lambda x: F.array_compact(F.transform(x, lambda t, i: F.when(t == eos, i + 1)))

    def row(x: Column, o: Column) -> Column:
        n = F.greatest(F.size(x) - 1, F.lit(0))
        place = lambda i: i - F.coalesce(F.array_max(F.filter(o, lambda p: p <= i)), F.lit(0))
        each = lambda f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array())
        parts = {"input_ids": F.slice(x, F.lit(1), n), "label_ids": F.slice(x, F.lit(2), n), "position_ids": each(place).cast("array<int>"), "label_mask": each(lambda i: place(i + 1) != 0).cast("array<boolean>")}
        return F.struct(*(c.alias(k) for k, c in parts.items()))

    return let(F.coalesce(ids, none), lambda x: let(opens(x), lambda o: row(x, o)))


def context_slice(x: Column, rank: Column | int, ranks: int) -> Column:
    """The part of an array that a context-parallel rank has: [rank * n / ranks, (rank + 1) * n / ranks)."""
    rank = F.lit(rank) if isinstance(rank, int) else rank
    low, high = F.floor(rank * F.size(x) / ranks), F.floor((rank + 1) * F.size(x) / ranks)
    return F.slice(x, (low + 1).cast("int"), (high - low).cast("int"))


def one_tokenizer(df: DataFrame, batch: list[str], tokenizer: str) -> DataFrame:
    """(batch, tokenizer) of each batch; reading it fails if a batch's samples are of more than one tokenizer."""
    low, high = F.min(tokenizer), F.max(tokenizer)
    return df.groupBy(*batch).agg(F.when(low == high, low).when(low != high, F.raise_error(F.lit("a batch mixes tokenizers"))).alias(tokenizer))


def supervised_rows(prompt: Column, completion: Column, length: int, eos: int, pad: int) -> Column:
    """A struct of input_ids, label_ids, position_ids, label_mask and attention_mask of prompt + completion + eos, each of length + 1.

    What is longer is cut, what is shorter padded on the right. Labels are the ids themselves; the mask holds for tokens after the prompt, the eos among them.
    Positions are -1 on padding. Null ids count as none. Keep rows with a label: exists(label_mask, x -> x). Select it by inline(array(...)), which
    evaluates it once.
    """
    none = F.array().cast("array<int>")
    every = F.sequence(F.lit(0), F.lit(length))

    def row(whole: Column, p: Column) -> Column:
        n = F.size(whole)
        ids = pad_to(whole, length + 1, pad)
        parts = {
            "input_ids": ids, "label_ids": ids, "position_ids": F.transform(every, lambda i: F.when(i < n, i).otherwise(-1)),
            "label_mask": F.transform(every, lambda i: (i >= p) & (i < n)), "attention_mask": F.transform(every, lambda i: i < n),
        }
        return F.struct(*(c.alias(k) for k, c in parts.items()))

    p = F.coalesce(prompt, none)
    whole = lambda x: F.slice(F.concat(x, F.coalesce(completion, none), F.array(F.lit(eos))), 1, length + 1)
    return let(p, lambda x: let(whole(x), lambda w: let(F.size(x), lambda k: row(w, k))))


def padded_rows(df: DataFrame, batch: list[str], ids: str, pad: int) -> DataFrame:
    """df with ids padded on the right to its batch's longest and attention_mask; null ids are padding throughout."""
    size = F.coalesce(F.size(ids), F.lit(0))
    widest = df.groupBy(*batch).agg(F.max(size).alias("_width"))
    rows = df.join(widest, batch)
    filled = pad_to(F.coalesce(F.col(ids), F.array().cast("array<int>")), F.col("_width"), pad)
    mask = F.when(F.col("_width") > 0, F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: i < size)).otherwise(F.array().cast("array<boolean>"))
    return rows.withColumn("attention_mask", mask).withColumn(ids, filled).drop("_width")


def pad_to(ids: Column, length: Column | int, pad: int) -> Column:
    """ids with pads on the right up to `length`; longer ones stay."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(n - F.size(ids), F.lit(0)).cast("int")))
