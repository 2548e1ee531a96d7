"""Mixing sources to target weights along a curriculum whose weights change over time.

Every source has a share of all words and a *shape*: how its weight moves while training
runs (knots of a piecewise linear curve over time 0 to 1). The integral of a shape is the
source's demand so far; a document that starts after u words of its source is used when
that demand reaches u, so its time is the inverted integral and its place in the training
order the demand of all sources up to that time.

A source is read in the order of its documents' hashes, again from the start when its words
run out, until its target is met to the word. The mix that is written holds documents whole: the one
on a source's cut stays where at least half of its words fall to the target.

Defined results: null source is a source of its own, after all others; a null or empty text
has size 0, takes nothing and has no pass; rows with equal ids and texts follow each other in
any order, which changes no row's counts; an empty table gives an empty mix; columns of the
input keep any name in the written mix, as they are carried in one struct; ``assign`` adds the one
column ``_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import as_long, blank_words, table, text_or_empty, written

#: Weights over time, given to sources in turn: steady, rising, falling late.
SHAPES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.2), (0.6, 1.2), (1.0, 0.4)))
WEIGHTS = (1, 2, 3)
#: Parts of the hash range whose sizes are summed before documents are ordered inside them.
RANGES = 4096


def _pieces(shape) -> list[tuple[float, float, float, float, float]]:
    """(time, weight, slope, demand so far, length) of each piece, the whole integral being 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(shape, shape[1:]))
    out, so_far = [], 0.0
    for (t0, w0), (t1, w1) in zip(shape, shape[1:]):
        out.append((t0, w0 / area, (w1 - w0) / area / (t1 - t0), so_far, t1 - t0))
        so_far += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def demand(shape, time: Column) -> Column:
    """Integral of the shape up to a time, as a share of the whole."""
    parts = []
    for t0, w, slope, _, length in _pieces(shape):
        x = F.least(F.greatest(time - t0, F.lit(0.0)), F.lit(length))
        parts.append(x * w + x * x * (slope / 2))
    return sum(parts[1:], parts[0])


def time_of(shape, share: Column) -> Column:
    """Inverse of ``demand``: the time at which a share of a source's words has been used."""
    out = None
    for t0, w, slope, so_far, length in reversed(_pieces(shape)):
        c = F.greatest(share - so_far, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w * w) + c * (2 * slope), F.lit(0.0))) + w
        x = F.least(F.when(root > 0, c * 2 / root).otherwise(F.lit(0.0)), F.lit(length)) + t0
        out = x if out is None else F.when(share < upper, x).otherwise(out)  # noqa: F821
        upper = so_far  # noqa: F841
    return out


def _by_shape(pick: Column, make, shapes) -> Column:
    out = F.when(pick == 0, make(shapes[0]))
    for i, shape in enumerate(shapes[1:], 1):
        out = out.when(pick == i, make(shape))
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3, shapes=SHAPES) -> DataFrame:
    """``source``, ``source_size`` to their weight, target and shape.

    A source's target stops at ``most`` times its size. With sources in the order of
    size / weight, those that stop come first, and the rest share what is left by weight: the
    first place whose share is within its limit gives the level. One row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(by_name) - 1
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    share = (
        (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / F.sum("weight").over(after)
    )
    free = ranked.withColumn("_share", share).withColumn("_free", F.col("weight") * F.col("_share") <= most * F.col("source_size"))
    first = F.min(F.when(F.col("_free"), F.struct((F.col("source_size") / F.col("weight")).alias("a"), F.col("place").alias("b"), F.col("_share").alias("c")))).over(everything)
    capped = (most * F.col("source_size")).cast("double")
    return free.withColumn("_level", first["c"]).select(
        "source", "source_size", "weight",
        F.least(capped, F.coalesce(F.col("weight") * F.col("_level"), capped)).alias("target"),
        (F.col("place") % len(shapes)).cast("int").alias("shape"),
    )


def assign(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (or its columns ``carry``) with a struct ``_mix``: size, source_size, target, taken, and
    its passes, each (pass, words, position); position is the number of words of all sources used before."""
    return assigned(docs, **options).select("doc.*", F.col("mix").alias("_mix"))


def assigned(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, most: int = 3, shapes=SHAPES, carry: list[str] | None = None,
) -> DataFrame:
    """As ``assign``, with the columns of ``docs`` in a struct ``doc`` and the others in ``mix``."""
    digest = F.md5(F.concat_ws("|", F.col(f"`{key}`").cast("string"), F.md5(text_or_empty(text))))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"), F.col(f"`{source}`").cast("string").alias("source"),
        F.size(blank_words(text_or_empty(text))).cast("long").alias("size"), digest.alias("digest"),
    ).withColumn("range", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % RANGES)
    # one narrow pass over the texts: words by source and part of its hash range
    parts = written(sized.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-parts")
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most, shapes)
    order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("words").over(order), F.lit(0))).alias("p")
    totals = {f"w{i}": F.sum(F.when(F.col("shape") == i, F.col("target")).otherwise(0.0)).over(Window.partitionBy()) for i in range(len(shapes))}
    plan = plan.withColumns(totals).alias("t")
    offsets = starts.join(plan, F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        "p.source", "p.range", "start", "source_size", "target", "shape", *totals
    )
    inside = Window.partitionBy("source", "range").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.alias("d").withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.range") == F.col("o.range")), "left")
    )
    whole = F.round(F.col("target")).cast("long")
    at = F.col("start") + F.col("before")

    def one_pass(e):
        begins = at + e * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), whole - begins))
        share = begins / F.greatest(whole, F.lit(1))
        time = _by_shape(F.col("shape"), lambda s: time_of(s, share), shapes)
        place = sum((F.col(f"w{i}") * demand(s, time) for i, s in enumerate(shapes)), F.lit(0.0))
        return F.struct(e.cast("int").alias("pass"), words.cast("long").alias("words"), place.alias("position"))

    passes = F.filter(F.array(*[one_pass(F.lit(e)) for e in range(most)]), lambda p: p["words"] > 0)
    mixed = placed.select("doc", "d.digest", "d.size", "source_size", "target", passes.alias("passes"))
    return mixed.select(
        "doc",
        F.struct(
            "size", "source_size", "target", "digest",
            F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"), "passes",
        ).alias("mix"),
    )


def in_training_order(rows: DataFrame) -> DataFrame:
    """Rows of ``assigned``, one for each pass that takes half of the document or more, range-sorted
    by its ``pass.position``."""
    taken = F.filter("mix.passes", lambda p: 2 * p["words"] >= F.col("mix.size"))
    keys = [F.col("pass.position"), F.col("mix.digest"), F.col("pass.pass")]
    return rows.withColumn("pass", F.explode(taken)).repartitionByRange(*keys).sortWithinPartitions(*keys)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself in training order: a row of ``docs``, whole, for each of its passes."""
    return in_training_order(assigned(docs, **options)).select("doc.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(as_long("doc_id").alias("doc_id"), "text", "source")
    first = F.round(F.array_min(F.transform("_mix.passes", lambda p: p["position"])), 3)
    # the order needs no text
    lean = assign(docs, carry=["doc_id"]).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken", first.alias("position"), F.col("_mix.digest").alias("_digest"))
    keys = [F.col("position").asc_nulls_last(), F.col("_digest")]
    return lean.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_digest")
