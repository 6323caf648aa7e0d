"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equal token blocks. Slot i has the golden-ratio point frac((i + 1/2) phi), which the
cumulative target shares map to a source; the slots of a source are ranked, and the slot of rank j takes block j of the
source's token stream: its documents in a shuffled order (digest of seed and doc_id), one epoch after another. The
points' low discrepancy keeps every prefix of the mix near the targets; what the last slots of a source miss or exceed is
made up by a shorter last block and by closing slots at the end, so each source gives its target to a word.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the size of all documents; a target stops at
max_epochs times its source's size, and the excess is shared among the others by weight until none is above.

Defined cases: a very long text counts whole, and is cut where blocks end; null or empty text has size 0 and is never taken; a null source is a source of its own; documents with
equal digests go by doc_id; repeated rows are laid one after another; no rows in, no rows out; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, read_table, stored

GOLDEN = 0.6180339887498949
BLOCK_WORDS = 4096
#: Slots of the schedule whose ranks are counted together, and documents of a source whose sizes are added up together.
SLOTS_PER_CHUNK, BUCKETS = 1 << 16, 4096
WEIGHTS = (1, 2, 3)


def word_count(text):
    """A character for each word and its following blanks, counted; a list of a very long text's words would fill the heap."""
    begun = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A[\x20\x09-\x0D]++", "")
    return F.length(F.regexp_replace(begun, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sizes: source, source_size. Returns source, source_size, target; a row for each source.

    Sources fill in the order of cap over weight: below the level all are capped, above it they get level times weight.
    The table has a row for each source, so its windows need no partitions.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("i", F.row_number().over(one) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "i")
    everything = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # The level if every source before this one is capped and no other; the first that lies under its own cap holds for all.
    level = F.when((F.col("total") - F.col("cap_before")) * F.col("w") <= F.col("cap") * F.col("w_left"), (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    place = F.struct((F.col("cap") / F.col("w")).alias("ratio"), F.col("i"))
    ranked = ranked.withColumn("own", level).withColumn("open", F.min(F.when(F.col("own").isNotNull(), place)).over(everything))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("open.i") == F.col("i"), F.col("own"))).over(everything))
    capped = place < F.col("open")
    target = F.when(capped | F.col("open").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return ranked.select("source", "source_size", target.alias("target"))


def schedule(spark: SparkSession, targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Slots: slot, source, source_size, rank (of the slot in its source), first and last (words of the source's endless stream, last exclusive)."""
    plan = targets.where("source_size > 0").select("source", "source_size", F.round("target").cast("long").alias("words"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("high", F.sum("words").over(order)).withColumn("all", F.sum("words").over(Window.partitionBy()))
    plan = plan.select("source", "source_size", "words", ((F.col("high") - F.col("words")) / F.col("all")).alias("low"), (F.col("high") / F.col("all")).alias("high"))
    plan = stored(plan.coalesce(1), "mix-plan")
    total, n_sources = plan.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    slots = spark.range(-(-total // block)).select(F.col("id").alias("slot"), (((F.col("id") + 0.5) * GOLDEN) % 1.0).alias("u"))
    if n_sources * 64 <= BROADCAST_BYTES:  # a row of about 64 bytes for each source
        plan_side = F.broadcast(plan)
    else:
        plan_side = plan
    # Cells of the unit interval make the range join an equi-join: a point lies in one cell, a source in the few it touches.
    cells = max(1, min(1 << 20, 4 * n_sources))
    cut = plan_side.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    hit = slots.withColumn("cell", F.floor(F.col("u") * cells)).join(cut, "cell").where("u >= low and u < high").select("slot", "source", "source_size", "words")
    # Ranks in two steps: counts for each chunk of slots first, so no task sorts all slots of a source.
    hit = hit.withColumn("chunk", F.floor(F.col("slot") / SLOTS_PER_CHUNK))
    counts = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("s"), F.col("chunk").alias("c"), "ahead")
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("inside", inside).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).withColumn("rank", F.col("ahead") + F.col("inside"))
    drawn = ranked.select("slot", "source", "source_size", "rank", (F.col("rank") * block).alias("first"), F.least((F.col("rank") + 1) * block, "words").alias("last")).where("first < last")
    got = offsets.join(counts, F.col("s").eqNullSafe(F.col("source")) & (F.col("c") == F.col("chunk"))).groupBy("s").agg(F.max(F.col("ahead") + F.col("n")).alias("n"))
    closing = plan.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") * block < F.col("words"))
    closing = closing.withColumn("rank", F.explode(F.sequence(F.col("n"), F.floor((F.col("words") - 1) / block))))
    closing = closing.select((F.lit(-(-total // block)) + F.col("rank")).alias("slot"), "source", "source_size", "rank", (F.col("rank") * block).alias("first"), F.least((F.col("rank") + 1) * block, "words").alias("last"))
    return drawn.unionByName(closing)


def token_line(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs: doc_id, source, size. Adds start: the words of the source before the document in its shuffled order.

    Sums in two steps: for each bucket of digests first, so a hot source is laid out by many tasks.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    rows = docs.select("doc_id", "source", "size", key.alias("key")).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return laid.select("doc_id", "source", "size", (F.col("ahead") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """docs: doc_id, source, text. Returns a row for each: doc_id, source, size, source_size, target, taken, first_slot (null if nothing is taken), n_slots (that hold words of it)."""
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs).coalesce(1), "mix-targets")
    slots = schedule(spark, targets, block)
    # A document stands in the stream once for each epoch; its words there are cut at the blocks' ends.
    laid = stored(token_line(sized, seed).withColumn("n", F.monotonically_increasing_id()), "mix-line")
    per_source = targets.select(F.col("source").alias("s"), "source_size", "target")
    whole = laid.join(F.broadcast(per_source) if targets.count() * 64 <= BROADCAST_BYTES else per_source, F.col("source").eqNullSafe(F.col("s")))
    epochs = whole.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start"))
    cut = epochs.withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    met = cut.select("n", "source", "piece", "at", "size").join(slots.select(F.col("source").alias("ss"), "slot", "rank", "first", "last"), F.col("source").eqNullSafe(F.col("ss")) & (F.col("piece") == F.col("rank")))
    words = F.least(F.col("last"), F.col("at") + F.col("size")) - F.greatest(F.col("first"), F.col("at"))
    taken = met.withColumn("words", words).where("words > 0").groupBy("n").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    out = whole.join(taken, "n", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, i % 3 + 1 AS w, 3 * source_size AS cap FROM r),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap_before,
        CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_left,
        row_number() OVER (ORDER BY cap / w, i) AS k FROM w),
o AS (SELECT *, CASE WHEN (total - cap_before) * w <= cap * w_left THEN k END AS own FROM f),
l AS (SELECT *, min(own) OVER () AS open FROM o),
v AS (SELECT *, max(CASE WHEN k = open THEN CAST(total - cap_before AS DOUBLE) / w_left END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN open IS NULL OR k < open THEN CAST(cap AS DOUBLE) ELSE least(level * w, CAST(cap AS DOUBLE)) END AS target FROM v),
x AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
p AS (SELECT source, source_size, CAST(round(target) AS BIGINT) AS words FROM t WHERE source_size > 0),
q AS (SELECT *, CAST(sum(words) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS high, CAST(sum(words) OVER () AS BIGINT) AS total FROM p),
c AS (SELECT coalesce(CAST(ceil(max(total) / 4096) AS BIGINT), 0) AS n FROM q),
g AS (SELECT range AS slot, ((range + CAST(0.5 AS DOUBLE)) * CAST('0.6180339887498949' AS DOUBLE)) % CAST(1 AS DOUBLE) AS u FROM range((SELECT n FROM c))),
h AS (SELECT slot, source, words, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
        FROM g JOIN q ON u >= CAST(high - words AS DOUBLE) / total AND u < CAST(high AS DOUBLE) / total),
k AS (SELECT q.source, q.words, count(h.slot) AS n FROM q LEFT JOIN h ON q.source IS NOT DISTINCT FROM h.source GROUP BY q.source, q.words),
z AS (SELECT slot, source, rank, words FROM h WHERE rank * 4096 < words
      UNION ALL SELECT c.n + rank, source, rank, words FROM (SELECT source, words, unnest(range(n, (words - 1) // 4096 + 1)) AS rank FROM k WHERE n * 4096 < words), c),
e AS (SELECT x.doc_id, x.source, x.size, e.range * p.source_size + x.start AS place FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source, range(3) e WHERE x.size > 0),
b AS (SELECT *, unnest(range(place // 4096, (place + size - 1) // 4096 + 1)) AS piece FROM e),
m AS (SELECT b.doc_id, min(z.slot) AS first_slot, count(*) AS n_slots FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source AND b.piece = z.rank
        WHERE least((z.rank + 1) * 4096, z.words, b.place + b.size) > greatest(z.rank * 4096, b.place) GROUP BY b.doc_id)
SELECT x.doc_id, x.size, t.source_size, t.target,
  CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(round(t.target) / t.source_size) AS BIGINT) * x.size
    + greatest(0, least(x.start + x.size, CAST(round(t.target) AS BIGINT) % t.source_size) - x.start) END AS taken,
  m.first_slot, coalesce(m.n_slots, 0) AS n_slots
FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source LEFT JOIN m ON x.doc_id = m.doc_id
"""
