"""Mixing sources to target weights by capped water-filling.

Each source has a cap: ``most_epochs`` times its size. Targets start as weight shares of the
total; sources above their cap are clamped, and the excess is reshared by weight among
the others until none is above. A source's target over its size is its epochs: every
document is taken whole as often as the whole part says; the fraction is taken by walking
the documents in the order of a seeded hash until the words are filled, so a source is a
few words from its target and at most one document of it is cut.

The walk needs no sort of a source: sizes are summed by (source, hash slice), a slice
before the fill point is taken, and only the slice at the fill point is ordered, so a
source with a third of all rows costs one small window.

Defined results: null or empty text has size 0 and is taken 0 words; a null source is a source
of its own; rows that are equal in id, size and source share one place in the walk, and which of
them is cut says nothing (``mixed_documents`` gives them all the larger take); a corpus without words has targets 0; reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.session import stored

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixRule:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  # by source in code-point order, null last, repeating
    most_epochs: float = 3.0
    seed: str = "mix"
    total: float | None = None  # words of the mix; None: all words of the input


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, rule: MixRule) -> DataFrame:
    """source, source_size, target from (source, size) rows. One row per source is gathered to rank them."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in rule.weights]), F.pmod(place, F.lit(len(rule.weights))).cast("int") + 1)
    level = stored(
        by_source.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * rule.most_epochs).withColumn("clamped", F.lit(False))
    )
    while True:
        row = level.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(F.col("clamped"), F.col("cap"))).alias("full"),
            F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("weights"),
        ).first()
        total = float(row["words"] or 0) if rule.total is None else min(rule.total, rule.most_epochs * float(row["words"] or 0))
        share = (total - float(row["full"] or 0)) / row["weights"] if row["weights"] else 0.0
        filled = level.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.lit(share)))
        above = ~F.col("clamped") & (F.col("target") > F.col("cap"))
        if filled.where(above).isEmpty():
            return filled.select("source", "source_size", "target")
        level = stored(filled.withColumn("clamped", F.col("clamped") | above).drop("target"))


def hash_place(rule: MixRule) -> Column:
    """Seeded place of a document in the walk of its source: 60 bits of an MD5."""
    name = F.concat(F.lit(rule.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def mix_plan(docs: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole copies), extra (words of one more), taken."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_place(rule).alias("place")))
    targets = stored(source_targets(sizes, rule))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    epochs = F.floor(F.try_divide("target", "source_size"))
    need = F.round(F.col("target") - F.coalesce(epochs, F.lit(0)) * F.col("source_size")).cast("long")
    needs = targets.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long")).withColumn("need", need)

    cut = F.shiftright("place", 44)  # 60 bits: 65,536 slices
    slices = sizes.groupBy("source", cut.alias("slice")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    walked = slices.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    fill = walked.join(needs, same(walked, needs)).where(
        (F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("words"))
    ).select(walked["source"], "slice", "before")
    fill = stored(fill)  # at most one slice a source

    plan = sizes.join(needs, same(sizes, needs), "left").drop(needs["source"])
    plan = plan.join(fill, same(plan, fill), "left").drop(fill["source"])
    at_fill = plan.where(F.col("slice") == cut)
    # equal places are equal rows: the order within them is that of the size
    inside = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("need") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    at_fill = at_fill.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    elsewhere = plan.where(F.col("slice").isNull() | (F.col("slice") != cut)).withColumn(
        "extra", F.when((F.col("need") > 0) & (F.col("slice").isNull() | (cut < F.col("slice"))), F.col("size")).otherwise(F.lit(0))
    )
    both = elsewhere.unionByName(at_fill)
    return both.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", F.col("extra").cast("long").alias("extra"),
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its word number ``count``."""
    pieces = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, count), "")


def mixed_documents(docs: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """The mix itself: ``docs`` with every document repeated as planned, the last copy perhaps cut."""
    plan = mix_plan(docs, rule).where(F.col("taken") > 0).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
        F.struct("epochs", "extra").alias("__plan"),
    ).groupBy("__id", "__source", "__size").agg(F.max("__plan").alias("__plan"))
    sized = docs.withColumn("__words", word_count(F.col("text")))
    same = sized["doc_id"].eqNullSafe(F.col("__id")) & sized["source"].eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    whole = F.array_repeat(F.col("__size"), F.col("__plan.epochs").cast("int"))
    copies = F.when(F.col("__plan.extra") > 0, F.concat(whole, F.array(F.col("__plan.extra")))).otherwise(whole)
    taken = sized.join(plan, same).withColumn("__take", F.explode(copies))
    text = F.when(F.col("__take") < F.col("__size"), first_words(F.col("text"), F.col("__take").cast("int"))).otherwise(F.col("text"))
    out = taken.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
