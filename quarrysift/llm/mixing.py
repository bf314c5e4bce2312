"""Operator 2, mixing sources to target weights. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrysift.llm._common import Scratch, text_of, word_count
from quarrysift.operators.prefix import group_sums, hash_key, range_sums, sums_before
from quarrysift.session import spread


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Targets of the sources of sizes(source_key, source_size): share times all sizes, split by weight, none above most times its size.

    What a capped source can't take goes to the others by weight, until none is above: the level where the sum of
    min(cap, level * weight) meets the total. Sources in order of cap / weight: the first k are capped, for the least k at
    which the level of the rest stays below the next cap. One row for each source. Sources are ranked in one task, which sorts a
    name and a number for each: some ten million sources, not more.
    """
    order = Window.orderBy("source_key")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    all_, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(all_) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "source_key", "level"))).over(all_)["level"]
    return leveled.withColumn("final", level).select("source_key", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, payload: Column | None = None, owner: Scratch | None = None) -> DataFrame:
    """How many words of each document a mix takes.

    Documents of a source come in the order of a hash of seed and id. Whole epochs are taken while the source's budget (its
    target, rounded) allows, then the documents in order until the budget is met exactly; the last one is cut. Sources by
    code point, null last (a source of its own), get weights in turn. Returns row (the columns of docs, or payload), size, source_size,
    target, taken. Null text has size 0 and takes 0. Repeated ids are independent rows, ordered by size; an empty table
    gives no rows. Reruns agree.
    """
    rows = spread(docs).select(
        (F.struct("*") if payload is None else payload).alias("row"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("source_key"),
        hash_key(F.lit(seed), F.col(id_col)).alias("key"),
        word_count(text_of(text_col)).alias("size"),
    )
    fine = Scratch(docs.sparkSession, owner).keep(range_sums(rows, "source_key", "key", "size"), "ranges")
    targets = source_targets(group_sums(fine, "source_key", "source_size"), list(weights), share, most)
    placed = sums_before(rows, fine, "source_key", "key", "size", ["size"], "before")
    mixed = placed.join(targets, "source_key")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("long")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("before")))
    return mixed.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", epoch_col: str | None = None, **params) -> DataFrame:
    """The mix as rows with the columns of docs: a document once for each epoch that takes it, the one at the cut shortened.

    epoch_col, if given, is one more column: the epoch of the row, from 0; a shortened text is its document's last epoch. A
    shortened text ends after its last word taken; a column n_chars follows it. Documents without a word (null, empty) have
    nothing to take and go. Repeated rows are rows of their own, each with its epochs; other columns are as they were, nulls
    included; an empty table stays empty. Reruns agree.
    """
    mixed = mix_sources(docs, text_col=text_col, **params).where("taken > 0")
    copies = F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))
    rows = mixed.select("row", "size", F.explode(copies).alias("copy"), "taken")
    left = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    # The boundaries between a word and what follows; joining the first pieces gives back the text as it was.
    pieces = F.split(F.col("row")[text_col], r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    text = F.when(left < F.col("size"), F.array_join(F.slice(pieces, 1, left.cast("int")), "")).otherwise(F.col("row")[text_col])
    cut = rows.select("row", text.alias("__text"), (left < F.col("size")).alias("__cut"), F.col("copy").alias("__epoch"))
    changed = {text_col: F.col("__text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__cut"), F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    epoch = [F.col("__epoch").alias(epoch_col)] if epoch_col else []
    return cut.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns], *epoch)
