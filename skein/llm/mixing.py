"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n carries the golden-ratio point frac((n + 1) / phi); the source whose interval of cumulated target shares holds the
point gets the slot. The slots of a source are ranked, and rank r takes block r mod nb of the source in epoch r div nb:
the source's documents in the order of the md5 of their ids, laid end to end and cut into nb blocks of equally many words
(the last one is shorter). Slots past a source's target take nothing, the one that reaches it is cut there.
A source that the points give too few slots gets the lacking ones at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, materialize

#: 1 / phi.
GOLDEN = 0.6180339887498949
#: Slots beyond the expected number, as a share: what the discrepancy of short sequences may lack.
SPARE = 1.05
CHUNK = 1 << 16
BUCKETS = 1024


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """sizes (source, source_size) with target, lo, hi: a source's words to take and its interval of shares.

    Weights repeat over the sources in code-point order, null last. A target above `most` times its source's size stops
    there and the excess goes to the others by weight, until none is above: in the order of size by weight the sources
    stop until the first that its share, of what is left, does not fill. One row per source meets in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.select("*", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past, everything = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - (F.sum("cap").over(past) - F.col("cap"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(past) - F.col("weight")))
    levels = ranked.withColumn("level", level)
    # The level rises while sources stop and falls from the first that doesn't, so that one has the highest.
    shared = levels.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything)))
    upto = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("target").over(everything)
    return shared.select("source", "source_size", "target", F.try_divide(F.sum("target").over(upto) - F.col("target"), total).alias("lo"), F.try_divide(F.sum("target").over(upto), total).alias("hi"))


def block_words(total: int, least_target: float, most: int = 4096) -> int:
    """Words of a block: the least source gets 64 of them, as far as a million slots allow."""
    return max(1, total >> 20, min(most, int(least_target / 64)))


def schedule(goal: DataFrame, total: int, words: int) -> DataFrame:
    """slot, source, rank of every slot; goal as from targets(). Ranks come from counts per chunk of slots."""
    spark = goal.sparkSession
    slots = spark.range(int(total / words * SPARE) + 64).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("u"), (F.col("id") / CHUNK).cast("long").alias("chunk"))
    # An interval join on the cells of [0, 1) that a source's interval meets.
    cells = goal.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence((F.col("lo") * BUCKETS).cast("int"), (F.col("hi") * BUCKETS).cast("int"))).alias("cell"))
    placed = slots.withColumn("cell", (F.col("u") * BUCKETS).cast("int")).join(cells, "cell").where("u >= lo and u < hi").select("slot", "chunk", "source")
    counts = placed.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = placed.join(before, (F.col("source").eqNullSafe(F.col("s"))) & (F.col("chunk") == F.col("c")))
    return ranked.select("slot", "source", (F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1 + F.col("before")).alias("rank"))


def lacking(slots: DataFrame, per: DataFrame, words: int) -> DataFrame:
    """source, rank of the slots that a source's target needs beyond those that the points gave it.

    A source much smaller than a block has an interval that few points, or none, may hit. per: g, source_size, goal, blocks.
    """
    needed = (F.col("goal") / F.col("source_size")).cast("long") * F.col("blocks") + F.ceil(F.col("goal") % F.col("source_size") / words)
    had = slots.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("had"))
    short = per.where("source_size > 0").withColumn("needed", needed).join(had, F.col("g").eqNullSafe(F.col("s")), "left").withColumn("had", F.coalesce("had", F.lit(0))).where("needed > had")
    return short.select(F.col("g").alias("source"), F.explode(F.sequence("had", F.col("needed") - 1)).alias("rank"))


def takes(goal: DataFrame, total: int, words: int) -> DataFrame:
    """source, block, length, take of every slot: how much of a block it takes; only the slot that reaches the target
    takes a part. goal as from targets(). The words that a source's slots take are its target, rounded."""
    per = goal.select(F.col("source").alias("g"), "source_size", F.round("target").cast("long").alias("goal"), F.ceil(F.col("source_size") / words).alias("blocks"))
    slots = materialize(schedule(goal, total, words).select("source", "rank"))
    taken = slots.unionByName(lacking(slots, per, words)).join(per, F.col("source").eqNullSafe(F.col("g"))).withColumn("block", F.col("rank") % F.col("blocks"))
    length = F.least(F.lit(words), F.col("source_size") - F.col("block") * words)
    left = F.col("goal") - (F.col("rank") / F.col("blocks")).cast("long") * F.col("source_size") - F.col("block") * words
    return taken.select("source", "block", length.alias("length"), F.greatest(F.lit(0), F.least(length, left)).alias("take"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (and the columns in keep).

    size counts words of WORD (null text: 0). Documents without words take nothing; if no source has words all targets
    are 0. Repeated rows are documents of their own; ids, sources and texts may be null; an empty table gives no rows.
    A hot source is summed in 4096 buckets of its documents and met by blocks, never as a whole.
    """
    # Rows without an id are spread and ordered by their texts.
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.col(text_col)), F.lit("")).cast("binary"))
    tie = F.xxhash64(F.col(text_col)).alias("tie")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), md5.alias("md5"), tie, *keep)).withColumn("bucket", F.substring("md5", 1, 3))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    goal = materialize(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most))
    seen = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))), F.lit(0.0)).alias("least")).first()
    words = block_words(seen["total"], seen["least"])

    # Where each document starts in its source.
    before = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("md5", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = sized.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.sum("size").over(order) - F.col("size") + F.col("before"))
    laid = laid.join(goal.select(F.col("source").alias("g"), "source_size", "target"), F.col("source").eqNullSafe(F.col("g"))).select("doc_id", "source", "size", "source_size", "target", "start", *keep)

    taken = takes(goal, seen["total"], words)
    picks = taken.groupBy(F.col("source").alias("p"), "block").agg(F.sum(F.when(F.col("take") == F.col("length"), 1).otherwise(0)).alias("times"), F.max(F.when(F.col("take") < F.col("length"), F.col("take")).otherwise(0)).alias("part"))

    spans = laid.where("size > 0").withColumn("block", F.explode(F.sequence((F.col("start") / words).cast("long"), ((F.col("start") + F.col("size") - 1) / words).cast("long"))))
    met = spans.withColumnRenamed("block", "at").join(picks, F.col("source").eqNullSafe(F.col("p")) & (F.col("at") == F.col("block")), "left")
    own = F.greatest(F.col("start") - F.col("at") * words, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("at") * words, F.lit(words))
    got = F.coalesce(F.col("times") * (end - own) + F.greatest(F.lit(0), F.least(F.col("part"), end) - own), F.lit(0))
    columns = ["doc_id", "source", "size", "source_size", "target", "start", *keep]
    full = met.groupBy(*columns).agg(F.sum(got).cast("long").alias("taken"))
    none = laid.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken", *keep)


#: mix() over documents in DuckDB: of a source's documents, laid end to end and repeated, its target's words are taken.
ORACLE = """
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, md5(coalesce(doc_id::varchar, 'text:' || text, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5.0::double, 2.0::double, 1.0::double])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, 3.0::double * source_size as cap from s),
l as (select *, (sum(source_size) over ()::double - (sum(cap) over r - cap)) / (sum(weight) over () - (sum(weight) over r - weight)) as level from w
  window r as (order by cap / weight, source nulls last rows between unbounded preceding and current row)),
k as (select source, source_size, least(cap, weight * (select max(level) from l)) as target, round(least(cap, weight * (select max(level) from l)))::bigint as taken from l),
e as (select d.*, sum(size) over (partition by source order by h, doc_id nulls last, size rows between unbounded preceding and current row) - size as start from d)
select e.doc_id, e.source, e.size::bigint as size, k.source_size, k.target,
  (case when e.size = 0 then 0 else (k.taken // k.source_size) * e.size + greatest(0, least(k.taken % k.source_size - e.start, e.size)) end)::bigint as taken
from e join k on e.source is not distinct from k.source
"""
