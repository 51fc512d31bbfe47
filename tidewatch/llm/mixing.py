"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

The mixture is a row of slots.  Slot k has the point frac(k / golden ratio), which falls in one source's
part of the cumulative targets, so every stretch of slots holds the sources in nearly the target
proportions.  The documents of a source, in the order of a hash of their ids, make one stream that is
read again from its start when the target is larger than the source; it is cut in as many blocks of
equal words as the source has slots, and the slots of the source, ranked, take these blocks in turn.

All positions are counted in two levels, (source, hash cell) and row, so a hot source is spread over
4,096 cells and its slots over chunks.  Rows of ids and sizes move, not texts; only ``mixed_documents`` moves those,
to their cell and to their place in the mixture.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.window import WindowSpec

from tidewatch.llm.common import id_hash
from tidewatch.llm.words import n_words
from tidewatch.session import stage

GOLDEN = 0.6180339887498949
BLOCK_WORDS = 1024
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
#: Slots of one chunk are ranked together.
CHUNK = 1 << 16
#: The unit interval is met in so many cells when points look up their source.
CELLS = 1024


def point(k: Column) -> Column:
    """frac(k * GOLDEN) without loss for k up to 2**40."""
    step = (GOLDEN * (1 << 20)) % 1.0
    low = k.bitwiseAND((1 << 20) - 1) * F.lit(GOLDEN)
    u = low + F.shiftright(k, 20) * F.lit(step)
    return u - F.floor(u)


def fill_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of (source, source_size): ``share`` of all words by weight, at most ``most`` times each source.

    Sources in the order of their code points, null last, take the weights in turn.  In the order of
    size over weight the full sources come first, so the level of the others follows from running
    sums.  One row per source is all that this step sees in one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    ahead = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    room = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(ahead), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    return (
        sources.withColumn("weight", w).withColumn("ratio", cap / F.col("weight"))
        .withColumn("level", room / rest).withColumn("nth", F.row_number().over(by_ratio))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least(cap, F.col("weight") * F.col("level")), cap))
        .drop("weight", "ratio", "level", "nth")
    )


def slots(sources: DataFrame, total: int, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, skey, block): the schedule of ``total`` words over sources with a whole target in ``take``.

    A source whose part is so small that no point falls in it gets one slot after the others.
    """
    spark = sources.sparkSession
    n = max(1, -(-total // block)) if total else 0
    upto = F.sum("take").over(W.orderBy("skey"))
    spans = sources.filter("take > 0").withColumn("hi", upto / F.lit(float(max(total, 1)))).withColumn(
        "lo", (upto - F.col("take")) / F.lit(float(max(total, 1)))
    )
    first = F.floor(F.col("lo") * CELLS)
    last = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = spans.select("skey", "lo", "hi", F.explode(F.sequence(first, last)).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(cells, "cell").filter("u >= lo AND u < hi").select("skey", "slot")
    late = spans.join(drawn.select("skey").distinct(), "skey", "left_anti").select(
        "skey", (F.row_number().over(W.orderBy("skey")) + (n - 1)).cast("long").alias("slot")
    )
    drawn = drawn.unionByName(late).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    chunks = drawn.groupBy("skey", "chunk").agg(F.count("*").alias("n"))
    chunks = chunks.withColumn("rank0", F.sum("n").over(W.partitionBy("skey").orderBy("chunk")) - F.col("n"))
    ranked = drawn.withColumn("nth", F.row_number().over(W.partitionBy("skey", "chunk").orderBy("slot")) - 1)
    return ranked.join(chunks.select("skey", "chunk", "rank0"), ["skey", "chunk"]).select(
        "slot", "skey", (F.col("rank0") + F.col("nth")).alias("block")
    )


def _rows_of(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """A row per document with its size, source key, hash and cell, and ``carry`` with an underscore before the names."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *[F.col(c).alias(f"_{c}") for c in carry])
    key = id_hash(F.col("doc_id"))
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    return rows.withColumn("key", key).withColumn("cell", F.substring(key, 1, 3))


def _stream() -> WindowSpec:
    """The order of the rows of a source within a cell; rows that are equal here are of one id and size."""
    return W.partitionBy("skey", "cell").orderBy("key", "size")


def allocate(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> tuple[DataFrame, DataFrame]:
    """Place every document in its source's stream, and the sources with their targets.

    First result, a row per document: doc_id, source, size, skey, cell, nth (these three name the row),
    start (words of its source before it), source_size, target and take (the target in whole words).
    Null text has size 0; null sources are a source; repeated rows are rows of their own.
    """
    rows = stage(_rows_of(docs), "mix_rows")
    cells = stage(rows.groupBy("skey", "source", "cell").agg(F.sum("size").alias("words")), "mix_cells")
    sources = cells.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
    sources = stage(fill_targets(sources, weights, share, most).withColumn("take", F.round("target").cast("long")), "mix_sources")
    start0 = F.sum("words").over(W.partitionBy("skey").orderBy("cell")) - F.col("words")
    cells = cells.select("skey", "cell", start0.alias("start0")).join(
        sources.select("skey", "source_size", "target", "take"), "skey"
    )
    inside = _stream()
    upto = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("nth", F.row_number().over(inside)).withColumn("before", upto - F.col("size"))
    placed = placed.join(cells, ["skey", "cell"]).withColumn("start", F.col("start0") + F.col("before"))
    return placed.drop("key", "before", "start0"), sources


def _block_of(p: Column) -> Column:
    long_part = F.col("extra") * (F.col("q") + 1)
    return F.when(p < long_part, F.floor(p / (F.col("q") + 1))).otherwise(F.col("extra") + F.floor((p - long_part) / F.col("q")))


def _block_start(b: Column) -> Column:
    return b * F.col("q") + F.least(b, F.col("extra"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mixture: a row per part of a document in a slot, and a row without a slot for documents not taken.

    Columns: those of ``allocate``, read (0 for the first reading of a source), slot, place (words of the
    slot before the part), first_word, part_words.
    """
    placed, sources = allocate(docs, **options)
    total = sources.agg(F.sum("take")).first()[0] or 0
    most = int(-(-options.get("most", MOST) // 1))
    chosen = stage(slots(sources, total, block), "mix_slots")
    counts = chosen.groupBy("skey").agg(F.count("*").alias("n_slots"))
    per_cell = placed.select("skey", "cell", "take").distinct().join(counts, "skey").select(
        "skey", "cell", F.greatest(F.floor(F.col("take") / F.col("n_slots")), F.lit(1)).alias("q"),
        (F.col("take") % F.col("n_slots")).alias("extra"),
    )
    lo = F.col("start") + F.col("read") * F.col("source_size")
    reads = placed.withColumn("read", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    reads = reads.withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take"))).filter("lo < hi")
    parts = reads.join(per_cell, ["skey", "cell"])
    parts = parts.withColumn("block", F.explode(F.sequence(_block_of(F.col("lo")), _block_of(F.col("hi") - 1))))
    begin, end = F.greatest("lo", _block_start(F.col("block"))), F.least("hi", _block_start(F.col("block") + 1))
    parts = parts.withColumn("place", begin - _block_start(F.col("block")))
    parts = parts.withColumn("first_word", begin - F.col("lo")).withColumn("part_words", end - begin)
    parts = parts.drop("lo", "hi", "q", "extra").join(chosen, ["skey", "block"]).drop("block")
    none = placed.filter("size = 0 OR start >= take")
    return parts.unionByName(none, allowMissingColumns=True)


def taken(docs: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """Per document, how many of its words the mixture takes: doc_id, size, source_size, target, taken, slots."""
    row = ["skey", "cell", "nth"]
    return mix(docs, block, **options).groupBy(*row, "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum("part_words"), F.lit(0)).cast("long").alias("taken"), F.count("slot").alias("slots")
    ).drop(*row)


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mixture as documents: a row per document and reading, with the columns of ``docs``, in the order of the schedule.

    A reading stands where its first part does, by slot and place, and has the words of its parts.  The streams
    are read up to their targets, so at most one document of each source and reading is cut; it keeps its
    first words, joined by one space.  n_chars, if there, follows the text.  Texts meet the schedule by the place of
    their row in the stream.
    """
    row = ["skey", "cell", "nth"]
    parts = mix(docs, block, **options).filter("slot IS NOT NULL")
    reads = parts.groupBy(*row, "read").agg(F.min(F.struct("slot", "place")).alias("at"), F.sum("part_words").alias("left"))
    reads = reads.groupBy(*row).agg(F.collect_list(F.struct("read", "at", "left")).alias("reads"))
    texts = _rows_of(docs, docs.columns).withColumn("nth", F.row_number().over(_stream())).drop("key")
    # one partition holds a cell's texts and its readings, so a window gives them to each other without another shuffle
    both = texts.withColumn("has_text", F.lit(True)).unionByName(reads, allowMissingColumns=True)
    own = W.partitionBy(*row)
    both = both.withColumn("reads", F.first("reads", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    reads = both.filter("has_text").select("*", F.inline("reads")).drop("reads")
    words = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("left").cast("int")), " ")
    reads = reads.withColumn("_text", F.when(F.col("left") < F.col("size"), words).otherwise(F.col("_text")))
    if "n_chars" in docs.columns:
        length = F.length("_text").cast(docs.schema["n_chars"].dataType)
        reads = reads.withColumn("_n_chars", F.when(F.col("left") < F.col("size"), length).otherwise(F.col("_n_chars")))
    return reads.orderBy("at").select(*[F.col(f"_{c}").alias(c) for c in docs.columns])
