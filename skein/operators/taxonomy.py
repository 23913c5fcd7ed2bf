"""Classification against a taxonomy of vectors, and measures of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine_guarded
from skein.operators.stored import small_batches, written


def classify(items: DataFrame, taxonomy: DataFrame, most: int = 3, least: float = 0.1) -> DataFrame:
    """key, category, score: the best `most` categories of each item, then those with score >= least.

    taxonomy (category, centre) is a few rows; it becomes one array literal column, so each item is scored in place
    without a join of pairs or a shuffle.
    """
    entries = [(r["category"], list(map(float, r["centre"]))) for r in taxonomy.orderBy("category").collect()]
    scored = F.array(*[F.struct(F.round(cosine_guarded(F.col("vector"), F.array(*map(F.lit, c))), 6).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("category")) for i, (n, c) in enumerate(entries)])
    best = F.slice(F.sort_array(scored, asc=False), 1, most)
    return items.select("key", F.explode(best).alias("s")).select("key", "s.category", "s.score").where(F.col("score") >= least)


def centroids(items: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """category, centre: mean vectors by label, as one aggregate of partial sums."""
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dim)]
    return items.groupBy(F.col(label).cast("string").alias("category")).agg(F.array(*means).alias("centre"))


def metrics(classes: DataFrame, total: int) -> DataFrame:
    """coverage, avg_categories, avg_confidence, balance, categories of a classification: one row."""
    sizes = classes.groupBy("category").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count("*").alias("categories"))
    items = classes.groupBy("key").agg(F.count("*").alias("n"), F.max("score").alias("top")).agg(F.count("*").alias("covered"), F.avg("n").alias("avg_n"), F.avg("top").alias("avg_top"))
    return items.crossJoin(sizes).select(F.round(F.col("covered") / total, 3).alias("coverage"), F.round("avg_n", 3).alias("avg_categories"), F.round("avg_top", 3).alias("avg_confidence"), F.round(1 / (1 + F.col("sd") / F.col("mean")), 3).alias("balance"), "categories")


def merge_candidates(classes: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b, jaccard of category pairs whose sets of items overlap; pairs arise only from shared items."""
    sizes = classes.groupBy("category").agg(F.count("*").alias("n"))
    left, right = classes.select("key", F.col("category").alias("a")), classes.select("key", F.col("category").alias("b"))
    common = left.join(right, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    joined = common.join(sizes.select(F.col("category").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("category").alias("b"), F.col("n").alias("nb")), "b")
    return joined.select("a", "b", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard")).where(F.col("jaccard") >= least)


def discovered(items: DataFrame, classes: DataFrame, taxonomy: DataFrame, weak_below: float = 0.2, least_count: int = 3, most: int = 5) -> DataFrame:
    """category, centre of new categories: the most frequent words of the names of items that no category fits well.

    items (key, name, vector). A centre is the mean vector of the weak items with the word; words that name a category
    already are left out.
    """
    from skein.functions.text import code_tokens

    strong = classes.where(F.col("score") >= weak_below).select("key").distinct()
    words = items.join(strong, "key", "left_anti").select("key", "vector", F.explode(F.array_distinct(code_tokens(F.col("name")))).alias("category")).where(F.length("category") >= 3)
    fresh = words.join(taxonomy.select("category"), "category", "left_anti")
    sums = fresh.select("category", F.posexplode("vector").alias("at", "x")).groupBy("category", "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    centres = sums.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"].cast("double")).alias("centre"), F.max("n").alias("n"))
    return centres.where(F.col("n") >= least_count).orderBy(F.col("n").desc(), "category").limit(most).select("category", "centre")


def merged_categories(taxonomy: DataFrame, pairs: DataFrame) -> DataFrame:
    """taxonomy with every category that a pair names beside a shorter (of equals: earlier) one left to that one."""
    shorter = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    gone = pairs.select(F.when(shorter, F.col("b")).otherwise(F.col("a")).alias("category")).distinct()
    return taxonomy.join(gone, "category", "left_anti")


def halves(items: DataFrame, classes: DataFrame, taxonomy: DataFrame, more_than: int = 20, least: int = 3, apart: float = 0.9, rounds: int = 10) -> DataFrame:
    """category, of, centre of the halves of categories with more than `more_than` items; `of` is what they take the place of.

    All such categories are cut at once by two-means over the cosine: each starts from its item of least key and the item
    least like that, and a round is one join with the centres, a few rows, and one aggregate of partial sums. A category
    stays whole if a half has fewer than `least` items or the cosine of the halves is `apart` or above. The half with the
    least key is "-1", the other "-2"; halves are not cut again. Null vectors belong to no half.
    """
    spark = items.sparkSession
    large = classes.where(~F.contains("category", F.lit("-"))).groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("category")
    members = written(classes.select("key", "category").join(large, "category", "left_semi").join(items.select("key", "vector").where("vector is not null"), "key"))
    first = members.groupBy("category").agg(F.min_by("vector", "key").alias("a"))
    # Categories are few, and so are their centres.
    far = members.join(F.broadcast(first), "category").groupBy("category").agg(F.first("a").alias("a"), F.min_by("vector", F.struct(F.round(cosine_guarded(F.col("vector"), F.col("a")), 9), F.col("key"))).alias("b"))
    rows = [(r["category"], list(map(float, r["a"])), list(map(float, r["b"]))) for r in far.collect()]
    sizes: dict[tuple[str, bool], tuple] = {}
    for _ in range(rounds):
        if not rows:
            break
        centres = F.broadcast(spark.createDataFrame(rows, "category string, a array<double>, b array<double>"))
        dealt = members.join(centres, "category").withColumn("near_b", F.round(cosine_guarded(F.col("vector"), F.col("b")), 9) > F.round(cosine_guarded(F.col("vector"), F.col("a")), 9))
        dim = max(len(r[1]) for r in rows)
        means = dealt.groupBy("category", "near_b").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.bit_xor(F.xxhash64("key")).alias("mark"), F.array(*[F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(dim)]).alias("centre")).collect()
        now = {(r["category"], r["near_b"]): r for r in means}
        # Categories of which one side is empty are left as they are.
        rows = [(c, list(now[c, False]["centre"]), list(now[c, True]["centre"])) for c, _, _ in rows if (c, False) in now and (c, True) in now]
        marks = {k: (r["n"], r["mark"]) for k, r in now.items()}
        if marks == {k: v[:2] for k, v in sizes.items()}:
            break
        sizes = {k: (r["n"], r["mark"], r["first"]) for k, r in now.items()}
    out = []
    for c, a, b in rows:
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        length = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        if min(sizes[c, False][0], sizes[c, True][0]) >= least and dot < apart * length:
            ordered = sorted([(sizes[c, False][2], a), (sizes[c, True][2], b)], key=lambda x: x[0])
            out += [(f"{c}-{i}", c, centre) for i, (_, centre) in enumerate(ordered, 1)]
    return spark.createDataFrame(out, "category string, of string, centre array<double>")


def refine(items: DataFrame, taxonomy: DataFrame, rounds: int = 5, split_above: int | None = None) -> tuple[DataFrame, list[dict]]:
    """The taxonomy after up to `rounds` rounds of classifying, discovering, splitting and merging, and the measures of each.

    Categories with more than split_above items are split in halves, where that is given. A taxonomy is a few rows; it comes to the driver each round, so that the plan does not grow. Ends early where a round
    changes nothing. The items and each round's classes are written once and read by every step that uses them.
    """
    items = written(items)
    spark, schema, total, seen = items.sparkSession, "category string, centre array<double>", items.count(), []
    for _ in range(rounds):
        classes = written(classify(items, taxonomy))
        seen.append(metrics(classes, total).first().asDict())
        grown = taxonomy.select("category", F.col("centre").cast("array<double>").alias("centre")).unionByName(discovered(items, classes, taxonomy))
        if split_above is not None:
            cut = halves(items, classes, taxonomy, split_above)
            grown = grown.join(cut.select(F.col("of").alias("category")).distinct(), "category", "left_anti").unionByName(cut.select("category", "centre"))
        kept = merged_categories(grown, merge_candidates(classes).select("a", "b"))
        rows = sorted((r["category"], list(r["centre"])) for r in kept.collect())
        same = [r[0] for r in rows] == sorted(r["category"] for r in taxonomy.select("category").collect())
        taxonomy = spark.createDataFrame(rows, schema)
        if same:
            break
    return taxonomy, seen


#: Items of a block; two blocks are what a task compares at a time.
BLOCK = 256


def _blocks(items: DataFrame, group: str, size: int) -> DataFrame:
    """group, no, of, rows: the items (ord, key, unit) of every group dealt by their key into `of` blocks of about size."""
    n = items.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("of"))
    dealt = items.join(n, group).withColumn("no", F.pmod(F.xxhash64("key"), F.col("of")).cast("int"))
    return dealt.groupBy(group, "of", "no").agg(F.collect_list(F.struct("ord", "key", "unit")).alias("rows"))


def _resembling(items: DataFrame, others: DataFrame, group: str, threshold: float, size: int) -> DataFrame:
    """group, key, other: pairs of an item and an earlier one of others, in one group, whose cosine reaches the threshold.

    Blocks of items are dealt to the blocks of others by number, so no task has a group to itself.
    """
    import numpy as np
    import pandas as pd

    mine, theirs = _blocks(items, group, size), _blocks(others, group, size)
    count = theirs.groupBy(group).agg(F.max("of").alias("many"))
    dealt = mine.select(group, "rows").join(count, group).withColumn("no", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    pairs = dealt.join(theirs.select(group, "no", F.col("rows").alias("others")), [group, "no"]).select(group, "rows", "others")

    def compare(frames):
        for frame in frames:
            for g, rows, rest in zip(frame[group], frame["rows"], frame["others"], strict=True):
                x, y = (np.array([list(r["unit"]) for r in part], dtype=float) for part in (rows, rest))
                orders = [[(r["ord"], r["key"]) for r in part] for part in (rows, rest)]
                hit = [(i, j) for i, j in np.argwhere(x @ y.T >= threshold).tolist() if orders[1][j] < orders[0][i]]
                if hit:
                    yield pd.DataFrame({group: [g] * len(hit), "key": [rows[i]["key"] for i, _ in hit], "other": [rest[j]["key"] for _, j in hit]})

    kinds = dict(items.dtypes)
    return pairs.mapInPandas(compare, f"{group} {kinds[group]}, key {kinds['key']}, other {kinds['key']}")


def greedy_distinct(items: DataFrame, group: str, threshold: float = 0.85, size: int = BLOCK) -> DataFrame:
    """group, key of the items (group, ord, key, vector) that no earlier kept item of their group resembles, in order.

    The kept ones are the first maximal independent set of the pairs that resemble each other, in the order of (ord,
    key). Prefixes of each group that double in length are decided one after the other: what resembles a kept item goes,
    and only the few that are left are compared among themselves, in rounds in which every item without an undecided
    earlier neighbour stays. No group is gathered, and pairs within a crowd of like items are never listed, since its
    first one takes the others away. Equal vectors are one item; null vectors and those without length resemble nothing.
    A Python worker holds a few pairs of blocks at a time, however many its task has.
    """
    with small_batches(items.sparkSession):
        return _greedy(items, group, threshold, size)


def _greedy(items: DataFrame, group: str, threshold: float, size: int) -> DataFrame:
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("vector", lambda x: x.cast("double") / (length + 1e-9))
    all_items = items.where("vector is not null").select(group, "ord", "key", unit.alias("unit"), (length > 0).alias("long"))
    alone = items.where("vector is null").select(group, "key").unionByName(all_items.where("not long").select(group, "key"))
    first = written(all_items.where("long").groupBy(group, "unit").agg(F.min(F.struct("ord", "key")).alias("x")).select(group, "x.ord", "x.key", "unit"))
    most = first.groupBy(group).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    steps = 0
    while size << steps < most:
        steps += 1
    # Where the prefixes end: exact places do not matter, only that later prefixes hold the earlier ones.
    shares = [F.lit(float(2**-i)) for i in range(steps, 0, -1)]
    ends = first.groupBy(group).agg((F.percentile_approx(F.col("ord").cast("double"), F.array(*shares), F.lit(1000)) if shares else F.array().cast("array<double>")).alias("ends"))
    step = F.size(F.filter("ends", lambda e: e < F.col("ord").cast("double")))
    staged = written(first.join(ends, group).withColumn("step", step).drop("ends"))
    kept = staged.where("false").drop("step")
    for i in range(steps + 1):
        left = staged.where(F.col("step") == i).drop("step")
        if i:
            left = left.join(_resembling(left, kept, group, threshold, size).select(group, "key").distinct(), [group, "key"], "left_anti")
        left = written(left)
        links = written(_resembling(left, left, group, threshold, size))
        while True:
            stay = written(left.join(links.select(group, "key").distinct(), [group, "key"], "left_anti"))
            gone = links.join(stay.select(group, F.col("key").alias("other")), [group, "other"], "left_semi").select(group, "key").distinct()
            kept = written(kept.unionByName(stay))
            left = written(left.join(stay.select(group, "key").unionByName(gone), [group, "key"], "left_anti"))
            if left.isEmpty():
                break
            open_ = left.select(group, "key")
            links = written(links.join(open_, [group, "key"], "left_semi").join(open_.withColumnRenamed("key", "other"), [group, "other"], "left_semi").select(group, "key", "other"))
    return kept.select(group, "key").unionByName(alone)


def frequent_patterns(names: DataFrame, least_length: int = 3, least_count: int = 3, most: int = 10) -> DataFrame:
    """token, n of the most frequent words of symbol names."""
    from skein.functions.text import code_tokens

    words = names.select(F.explode(code_tokens(F.col("name"))).alias("token")).where(F.length("token") >= least_length)
    return words.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least_count).orderBy(F.col("n").desc(), "token").limit(most)


def numbered(items: DataFrame, label: str, key: str) -> DataFrame:
    """Rank of every item inside its label."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(key)))
