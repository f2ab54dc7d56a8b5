"""Column-level data quality profile of a table that arrives in loads.

One scan counts the rows of each load by value, column by column, and, for tables of several columns, by the cells of all columns together;
each count is kept for two folds. The counts are stored, and everything follows from them. Exact base aggregates (rows, nulls, distinct values,
range, values outside the domain) are sums over them.

Changes between a load and the one before it are found by a classifier two-sample test: logistic regressions over indicator columns tell the
rows of the two loads apart; their cross-fitted discrimination (area under the ROC curve of the fold they were not trained on) is compared with
that of models from which columns are ablated: all but one (auc_alone) and only one (auc_without). A column is suspect if it alone reaches the
least area that a change of the asked size gives, or if the full model loses by its ablation. What is suspect is settled by the exact
largest difference of the two cumulative distributions.

The regressions are trained for all pairs of loads at once by DataFrame operations: gradient and curvature are sums over the counted cells, grouped by
pair, fold and indicator, combined before they are shuffled, so neither a pair nor a load is collected into one task or the driver. A model of
one column has its maximum in closed form, the logarithm of the ratio of the counts; one of several takes Newton steps on one column after another.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calypile.session import stored

#: Equal-width cells of a column's domain, in which rows are counted for the classifier.
CELLS = 256
#: Bins of about equal mass into which a pair's cells are merged, one indicator each: of a model of one column, and of one of several.
BINS, JOINT_BINS = 32, 8
#: Newton steps on each column of a model of several, and the ridge penalty of its coefficients.
ROUNDS, RIDGE = 2, 1.0
Domains = dict[str, tuple[float, float]]


def value_weights(df: DataFrame, load: str, domains: Domains) -> DataFrame:
    """(load_id, column_name, value, inside, cell, weight): the rows of each load by value, as double; -0.0 counts as 0.0."""
    long = df.select(
        F.col(f"`{load}`").alias("load_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for c, (a, b) in domains.items()])).alias("x"),
    ).select("load_id", "x.*")
    weighted = long.groupBy("load_id", "column_name", "lo", "hi", "value").agg(F.count(F.lit(1)).alias("weight"))
    return weighted.select("load_id", "column_name", "value", *_inside(F.col("value"), F.col("lo"), F.col("hi")), "weight")


def _cell(value: Column, lo: Column, hi: Column) -> Column:
    """The cell of a value inside its domain, else null."""
    return F.when(value.between(lo, hi), F.least(F.floor((value - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))).cast("int")


def _inside(value: Column, lo: Column, hi: Column) -> list[Column]:
    return [F.coalesce(value.between(lo, hi), F.lit(False)).alias("inside"), _cell(value, lo, hi).alias("cell")]


def numbered(tables: list[Domains]) -> list[list[int]]:
    """The kinds of each table's columns: all columns are numbered through, since tables may have columns of one name."""
    ends = list(accumulate(map(len, tables)))
    return [list(range(end - len(domains), end)) for end, domains in zip(ends, tables, strict=True)]


def _pick(values: list) -> Column:
    """The value for the row's kind."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("kind") + 1)


def counted(tables: list[tuple[DataFrame, Domains]], load: str, row_id: str) -> DataFrame:
    """(load_id, kind, value, cells, w0, w1), stored: the rows of each load by value, for the kind-th column, and by the cells of all columns of
    the t-th table together (kind -1 - t, of several columns only); w0 and w1 count the rows of two folds, told apart by a hash of row_id."""
    parts = []
    for t, ((df, domains), kinds) in enumerate(zip(tables, numbered([d for _, d in tables]), strict=True)):
        columns = [F.col(f"`{c}`").cast("double") for c in domains]
        none = F.lit(None).cast("array<int>")
        entries = [F.struct(F.lit(i).alias("kind"), c.alias("value"), none.alias("cells")) for i, c in zip(kinds, columns, strict=True)]
        if len(columns) > 1:
            cells = F.array(*[F.coalesce(_cell(c, F.lit(float(a)), F.lit(float(b))), F.lit(-1)) for c, (a, b) in zip(columns, domains.values(), strict=True)])
            entries.append(F.struct(F.lit(-1 - t).alias("kind"), F.lit(None).cast("double").alias("value"), cells.alias("cells")))
        fold = F.pmod(F.xxhash64(F.col(f"`{row_id}`").cast("string")), F.lit(2))
        long = df.select(F.col(f"`{load}`").alias("load_id"), fold.alias("fold"), F.explode(F.array(*entries)).alias("x")).select("load_id", "fold", "x.*")
        parts.append(long.groupBy("load_id", "kind", "value", "cells").agg(F.count_if(F.col("fold") == 0).alias("w0"), F.count_if(F.col("fold") == 1).alias("w1")))
    return stored(reduce(DataFrame.unionByName, parts), ["kind"])


def weighted_of(counts: DataFrame, tables: list[Domains]) -> DataFrame:
    """value_weights() of what is counted, with the two folds' counts."""
    bounds = [b for domains in tables for b in domains.values()]
    lo, hi = _pick([float(a) for a, _ in bounds]), _pick([float(b) for _, b in bounds])
    name = _pick([c for domains in tables for c in domains]).alias("column_name")
    return counts.where("kind >= 0").select("load_id", name, "value", *_inside(F.col("value"), lo, hi), (F.col("w0") + F.col("w1")).alias("weight"), "kind", "w0", "w1")


def base(weighted: DataFrame, column: str = "column_name") -> DataFrame:
    """Exact aggregates of each load and column; NaN and infinite values are outside the domain and not null."""
    w, v = F.col("weight"), F.col("value")
    return weighted.groupBy("load_id", column).agg(
        F.sum("weight").alias("n_rows"),
        F.sum(F.when(v.isNull(), w).otherwise(0)).alias("n_null"),
        F.sum(F.when(v.isNotNull() & ~F.col("inside"), w).otherwise(0)).alias("n_outside"),
        F.sum(F.when(F.col("inside"), w).otherwise(0)).alias("n_inside"),
        F.count(F.when(F.col("inside"), v)).alias("n_distinct"),
        F.min(F.when(F.col("inside"), v)).alias("min_inside"),
        F.max(F.when(F.col("inside"), v)).alias("max_inside"),
    )


def preceding(loads: DataFrame) -> DataFrame:
    """(load_id, prev_id): the load of the same sample with load_no less by one."""
    a = loads.select("load_id", "sample", (F.col("load_no") - 1).alias("load_no"))
    b = loads.select(F.col("load_id").alias("prev_id"), "sample", "load_no")
    return a.join(b, ["sample", "load_no"]).select("load_id", "prev_id")


def with_preceding(stats: DataFrame, pairs: DataFrame, column: str = "column_name") -> DataFrame:
    """stats with the preceding load's figures as prev_*; null where there is none or it delivered no row."""
    old = stats.select(F.col("load_id").alias("prev_id"), column, *[F.col(c).alias(f"prev_{c}") for c in ("n_rows", "n_null", "n_inside", "n_distinct")])
    return stats.join(pairs, "load_id", "left").join(old, ["prev_id", column], "left")


# --- classifier two-sample test


def _sides(pairs: DataFrame, *others: str) -> DataFrame:
    """(pair, others, _l, y): the two loads of each pair, y 1 for the later one."""
    role = F.explode(F.array(F.struct(F.col("load_id").alias("_l"), F.lit(1).alias("y")), F.struct(F.col("prev_id").alias("_l"), F.lit(0).alias("y")))).alias("r")
    return pairs.select(F.col("load_id").alias("pair"), *others, role).select("pair", *others, "r.*")


def _areas(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area) from (keys, fold, score, pos, neg): the area under the ROC curve of each fold, ties by half, averaged by the folds' rows.

    A fold without rows of one of the loads, or whose score is null, does not count; without any the area is null.
    """
    own = [*keys, "fold"]
    by = scored.where("score is not null").groupBy(*own, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*own).orderBy("score")) - F.col("neg") / 2
    folds = by.withColumn("_below", below).groupBy(*own).agg(F.sum(F.col("pos") * F.col("_below")).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    able = folds.where("p > 0 and n > 0").withColumn("w", F.col("p") + F.col("n"))
    return able.groupBy(*keys).agg((F.sum(F.col("a") / F.col("p") / F.col("n") * F.col("w")) / F.sum("w")).alias("area"))


def _ratio(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """The coefficient of an indicator in a model of one column, its maximum shrunk by half a row of each load; null if a load has no row."""
    return F.when((na > 0) & (nb > 0), F.log((a + 0.5) / (na + 0.5)) - F.log((b + 0.5) / (nb + 0.5)))


def _binned(weighted: DataFrame, sides: DataFrame) -> DataFrame:
    """(pair, kind, cell, a0, a1, b0, b1, na, nb, from_a, from_b, bin, joint): rows of both loads (a later, b earlier) in each cell and fold, and its bins.

    Rows without a usable value have cell null and bin 0; na and nb count the usable ones, from_a and from_b those in the cells before.
    """
    cells = weighted.groupBy(F.col("load_id").alias("_l"), "kind", "cell").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    pick = lambda y, w: F.sum(F.when(F.col("y") == y, F.col(w)).otherwise(0))
    both = cells.join(sides, "_l").repartition("pair", "kind").groupBy("pair", "kind", "cell").agg(pick(1, "w0").alias("a0"), pick(1, "w1").alias("a1"), pick(0, "w0").alias("b0"), pick(0, "w1").alias("b1"))
    own, usable = Window.partitionBy("pair", "kind"), F.col("cell").isNotNull().cast("int")
    sums = both
    for c in "ab":
        n = (F.col(f"{c}0") + F.col(f"{c}1")) * usable
        sums = sums.withColumn(f"n{c}", F.sum(n).over(own)).withColumn(f"from_{c}", F.sum(n).over(own.orderBy("cell")) - n)
    mass = ((F.col("a0") + F.col("a1")) / F.greatest("na", F.lit(1)) + (F.col("b0") + F.col("b1")) / F.greatest("nb", F.lit(1))) * usable
    sums = sums.withColumn("_m", mass).withColumn("_at", F.try_divide(F.sum("_m").over(own.orderBy("cell")) - F.col("_m") / 2, F.sum("_m").over(own)))
    number = lambda bins: F.when(usable == 1, F.least(F.floor(F.col("_at") * bins), F.lit(bins - 1)) + 1).otherwise(0).cast("int")
    return sums.select("pair", "kind", "cell", "a0", "a1", "b0", "b1", "na", "nb", "from_a", "from_b", number(BINS).alias("bin"), number(JOINT_BINS).alias("joint"))


def _alone(binned: DataFrame) -> DataFrame:
    """(pair, kind, auc_alone, auc_single, auc_error, top_bin, n_least) of models from which all other columns are ablated: over usable values, and
    in the coarser bins of the joint models over all rows. All steps group and join by the pair and kind, by which the cells are shuffled."""
    c = F.col
    tests = F.explode(F.array(F.struct(F.lit("auc_alone").alias("test"), c("bin").alias("at")), F.struct(F.lit("auc_single").alias("test"), (c("joint") + 1).alias("at")))).alias("x")
    bins = binned.repartition("pair", "kind").select("pair", "kind", "a0", "a1", "b0", "b1", "na", "nb", tests).where("x.at > 0").groupBy("pair", "kind", c("x.test").alias("test"), c("x.at").alias("at")).agg(*[F.sum(x).alias(x) for x in ("a0", "a1", "b0", "b1")], F.first("na").alias("na"), F.first("nb").alias("nb"))
    own = Window.partitionBy("pair", "kind", "test")
    rows = bins.withColumns({f"t{x}": F.sum(x).over(own) for x in ("a0", "a1", "b0", "b1")})
    fold = lambda f, g: F.struct(F.lit(f).alias("fold"), _ratio(c(f"a{g}"), c(f"b{g}"), c(f"ta{g}"), c(f"tb{g}")).alias("score"), c(f"a{f}").alias("pos"), c(f"b{f}").alias("neg"))
    scored = rows.select("pair", "kind", "test", F.explode(F.array(fold(0, 1), fold(1, 0))).alias("x")).select("pair", "kind", "test", "x.*")
    either = _areas(scored, ["pair", "kind", "test"]).groupBy("pair", "kind").agg(*[F.max(F.when(c("test") == t, c("area"))).alias(t) for t in ("auc_alone", "auc_single")])
    top = F.greatest((c("a0") + c("a1")) / F.greatest("na", F.lit(1)), (c("b0") + c("b1")) / F.greatest("nb", F.lit(1)))
    error = F.when((c("na") > 0) & (c("nb") > 0), F.sqrt((c("na") + c("nb") + 1) / (12.0 * c("na") * c("nb"))))
    fine = F.when(c("test") == "auc_alone", 1)
    least = F.least("ta0", "ta1", "tb0", "tb1")
    sizes = rows.groupBy("pair", "kind").agg(F.first(error).alias("auc_error"), F.coalesce(F.max(fine * top), F.lit(1.0)).alias("top_bin"), F.coalesce(F.max(fine * least), F.lit(0)).alias("n_least"))
    return sizes.join(either.hint("shuffle_hash"), ["pair", "kind"], "left")


def _design(counts: DataFrame, sides: DataFrame, binned: DataFrame, t: int, kinds: list[int]) -> DataFrame:
    """(pair, fold, y, b0 .. , w): the rows of each pair by the joint bins of all columns of the t-th table; bin 0 is no usable value, both loads weigh the same."""
    k = len(kinds)
    own = binned.where(F.col("kind").isin(kinds))
    maps = own.groupBy("pair").agg(*[F.map_from_entries(F.collect_list(F.when((F.col("kind") == kind) & F.col("cell").isNotNull(), F.struct("cell", "joint")))).alias(f"m{i}") for i, kind in enumerate(kinds)])
    rows = counts.where(F.col("kind") == -1 - t).withColumnRenamed("load_id", "_l").join(sides, "_l").join(maps, "pair")
    bins = [F.coalesce(F.try_element_at(f"m{i}", F.col("cells")[i]), F.lit(0)).alias(f"b{i}") for i in range(k)]
    names = [f"b{i}" for i in range(k)]
    cut = rows.select("pair", "y", *bins, "w0", "w1").groupBy("pair", "y", *names).agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    long = cut.select("pair", "y", *names, F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"w{f}").alias("n")) for f in (0, 1)])).alias("x")).select("pair", "y", *names, "x.*").where("n > 0")
    whole = Window.partitionBy("pair", "fold")
    long = long.withColumn("_n1", F.sum(F.col("n") * F.col("y")).over(whole)).withColumn("_n0", F.sum(F.col("n") * (1 - F.col("y"))).over(whole))
    share = F.when(F.col("y") == 1, F.col("n") / F.col("_n1")).otherwise(F.col("n") / F.col("_n0")) * (F.col("_n1") + F.col("_n0")) / 2
    return long.select("pair", "fold", "y", *names, "n", share.alias("w"))


def _fitted_area(design: DataFrame, columns: list[int]) -> DataFrame:
    """(pair, area): the cross-fitted area of the model of the given columns.

    Coefficients of a pair's two models are a map from the indicator's number. All steps group and join by the pair, by which the cells are shuffled
    once, so the whole training is one stage.
    """
    k, width = len(columns), JOINT_BINS + 1
    number = lambda model: [model * (k * width) + F.col(f"b{i}") + j * width for j, i in enumerate(columns)]
    eta = lambda model: sum((F.coalesce(F.try_element_at("beta", x), F.lit(0.0)) for x in number(model)), F.lit(0.0))
    rows, own, other = design.repartition("pair"), F.col("fold"), 1 - F.col("fold")  # a row trains the model that is tested on the other fold
    pos, neg = F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * (1 - F.col("y")))
    coefficients = rows.select("pair", "y", "w", F.explode(F.array(*number(other))).alias("at")).groupBy("pair", "at").agg((F.log((pos + 0.5) / (neg + 0.5)) / k).alias("beta"))
    for step in range(ROUNDS * k if k > 1 else 0, -1, -1):
        model = coefficients.groupBy("pair").agg(F.map_from_entries(F.collect_list(F.struct("at", "beta"))).alias("beta")).hint("shuffle_hash")
        if not step:
            break
        p = 1 / (1 + F.exp(-eta(other)))
        old = F.array(*[F.struct(x.alias("at"), F.coalesce(F.try_element_at("beta", x), F.lit(0.0)).alias("old")) for x in number(other)])
        fitted = rows.join(model, "pair").select("pair", "w", "y", p.alias("p"), F.explode(old).alias("x")).select("pair", "w", "y", "p", "x.*")
        sums = fitted.groupBy("pair", "at").agg(F.first("old").alias("old"), F.sum(F.col("w") * (F.col("y") - F.col("p"))).alias("g"), F.sum(F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"))
        moves = F.floor(F.col("at") / width) % k == step % k  # the column whose turn it is
        coefficients = sums.select("pair", "at", (F.col("old") + F.when(moves, (F.col("g") - RIDGE * F.col("old")) / (F.col("h") + RIDGE)).otherwise(0.0)).alias("beta"))
    tested = rows.join(model, "pair").select("pair", "fold", F.round(eta(own), 9).alias("score"), (F.col("n") * F.col("y")).alias("pos"), (F.col("n") * (1 - F.col("y"))).alias("neg"))
    return _areas(tested, ["pair"])


def areas(counts: DataFrame, binned: DataFrame, sides: DataFrame, tables: list[Domains]) -> DataFrame:
    """(load_id, kind, auc_full, auc_without, auc_alone, auc_error, top_bin, n_least) of each load against the preceding one.

    auc_full uses all columns of a table, auc_without all but this one, auc_alone only this one over its usable values; auc_error is the standard error of
    an area of 0.5 at these sizes, top_bin the largest share of a load in one bin, n_least the rows of the smaller load in the smaller fold.
    An area is null where no fold has rows of both loads. Of a single column, auc_full is auc_alone and auc_without 0.5.
    """
    alone, parts = stored(_alone(binned)), []
    for t, kinds in enumerate(numbered(tables)):
        out, k = alone.where(F.col("kind").isin(kinds)), len(kinds)
        if k == 1:
            parts.append(out.withColumn("auc_full", F.col("auc_alone")).withColumn("auc_without", F.lit(0.5)))
            continue
        design = stored(_design(counts, sides, binned, t, kinds))
        if k == 2:
            without = out.select("pair", (sum(kinds) - F.col("kind")).alias("kind"), F.col("auc_single").alias("auc_without"))
        else:
            without = reduce(DataFrame.unionByName, [_fitted_area(design, [j for j in range(k) if j != i]).select("pair", F.lit(kind).alias("kind"), F.col("area").alias("auc_without")) for i, kind in enumerate(kinds)])
        full = _fitted_area(design, list(range(k))).withColumnRenamed("area", "auc_full")
        parts.append(out.join(full, "pair", "left").join(without, ["pair", "kind"], "left"))
    every = reduce(DataFrame.unionByName, parts)
    return stored(every.select(F.col("pair").alias("load_id"), "kind", "auc_full", "auc_without", "auc_alone", "auc_error", "top_bin", "n_least"))


def two_sample(df: DataFrame, load: str, row_id: str, domains: Domains, pairs: DataFrame) -> DataFrame:
    """areas() of a table, by column_name; every row counts."""
    counts, sides = counted([(df, domains)], load, row_id), _sides(pairs)
    tests = areas(counts, stored(_binned(weighted_of(counts, [domains]), sides)), sides, [domains])
    return tests.select("load_id", _pick(list(domains)).alias("column_name"), *tests.columns[2:])


def least_area(shift: float) -> Column:
    """The area from which a column is suspect of a change of at least shift.

    Shares that differ by shift below some value differ by at least shift - top_bin below some bin's end, and the best model of the bins then has an
    area of at least half of that above 0.5. From it go what a model loses by training (its coefficients have a standard error of
    sqrt(2 * BINS / n) each, which costs at most 0.17 * sqrt(BINS / n) of the area) and three standard errors for chance. At 0.5 or less,
    every pair is suspect: so it is for small shifts, small loads, and loads with much in one bin.
    """
    return F.lit(0.5 + shift / 2) - F.col("top_bin") / 2 - 0.17 * F.sqrt(F.lit(float(BINS)) / F.greatest("n_least", F.lit(1))) - 3 * F.coalesce("auc_error", F.lit(1.0))


def suspects(tests: DataFrame, shift: float, column: str = "column_name") -> DataFrame:
    """(load_id, column, ground) whose distribution may have changed by shift: small where the test cannot tell, alone where the column by itself
    reaches the least area, ablation where the full model loses that much by leaving it out. The largest ground comes first."""
    least = least_area(shift)
    ground = (
        F.when(F.col("auc_alone").isNull() | (least <= 0.5), "small")
        .when(F.col("auc_alone") >= least, "alone")
        .when(F.col("auc_full") - F.col("auc_without") >= F.greatest(least - 0.5, 3 * F.col("auc_error")), "ablation")
    )
    return tests.withColumn("ground", ground).where("ground is not null").select("load_id", column, "ground")


def largest_difference(weighted: DataFrame, binned: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(load_id, kind, diff, of): the exact largest |n_cur(<= v) * N_old - n_old(<= v) * N_cur| over v, and N_cur * N_old.

    Cumulative counts are built over the domain's cells first (so they are in binned) and within each cell after, so a load is never one task.
    """
    sides, key = _sides(asked.join(pairs, "load_id"), "kind"), ["pair", "kind", "cell"]
    pick = lambda y: F.sum(F.when(F.col("y") == y, F.col("weight")).otherwise(0))
    usable = weighted.where("inside").withColumnRenamed("load_id", "_l").join(sides, ["_l", "kind"])
    values = usable.repartition(*key).groupBy(*key, "value").agg(pick(1).alias("a"), pick(0).alias("b"))
    inner = Window.partitionBy(*key).orderBy("value")
    cum = values.withColumn("cum_a", F.sum("a").over(inner)).withColumn("cum_b", F.sum("b").over(inner)).join(binned.select(*key, "na", "nb", "from_a", "from_b"), key)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    gap = F.abs((big("from_a") + big("cum_a")) * big("nb") - (big("from_b") + big("cum_b")) * big("na"))
    return cum.where("na > 0 and nb > 0").groupBy(F.col("pair").alias("load_id"), "kind").agg(F.max(gap).alias("diff"), F.max(big("na") * big("nb")).alias("of"))


def findings(df: DataFrame, table_name: str, loads: DataFrame, load: str, row_id: str, domains: Domains, null_shift: float = 0.10, factor: int = 4, shift: float = 0.30) -> DataFrame:
    """(table_name, column_name, load_id, aspect), the aspects range, nulls, distinct and distribution.

    range: a non-null value outside the domain. nulls: the share of nulls differs by at least null_shift from the preceding
    load's. distinct: the distinct values inside the domain are at most 1/factor or at least factor times the preceding
    load's, and not as many. distribution: for some v the shares of values <= v differ by at least shift. A load without a
    preceding one can only have range; so can rows whose load_id is not in loads. An empty table has no finding.
    """
    return findings_of([(df, table_name, domains)], loads, load, row_id, null_shift, factor, shift)


def findings_of(tables: list[tuple[DataFrame, str, Domains]], loads: DataFrame, load: str, row_id: str, null_shift: float = 0.10, factor: int = 4, shift: float = 0.30) -> DataFrame:
    """findings() of several tables that arrive in the same loads.

    All columns go through the same plans, and what several plans need is stored: the driver holds each stage of a plan, and replans what is left
    after each, so one small plan after another takes far less of its memory than the same work planned per table and at once.
    """
    columns = [domains for _, _, domains in tables]
    pairs = stored(preceding(loads))
    sides, counts = _sides(pairs), counted([(df, domains) for df, _, domains in tables], load, row_id)
    weighted = weighted_of(counts, columns)
    binned = stored(_binned(weighted, sides))
    stats = with_preceding(stored(base(weighted, "kind")), pairs, "kind")
    has = F.col("prev_n_rows").isNotNull()
    big = lambda c: F.col(c).cast("decimal(19,0)")
    exact = lambda x: F.lit(str(x)).cast("decimal(6,4)")
    rules = {
        "range": F.col("n_outside") > 0,
        "nulls": has & (F.abs(big("n_null") * big("prev_n_rows") - big("prev_n_null") * big("n_rows")) >= exact(null_shift) * (big("n_rows") * big("prev_n_rows")).cast("decimal(30,0)")),
        "distinct": has & (F.col("n_distinct") != F.col("prev_n_distinct")) & ((F.col("n_distinct") * factor <= F.col("prev_n_distinct")) | (F.col("n_distinct") >= F.col("prev_n_distinct") * factor)),
    }
    told = stats.select("kind", "load_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("aspect"))
    asked = suspects(areas(counts, binned, sides, columns), shift, "kind").select("load_id", "kind")
    moved = largest_difference(weighted, binned, asked, pairs).where(F.col("diff") >= exact(shift) * F.col("of").cast("decimal(30,0)"))
    every = told.unionByName(moved.select("kind", "load_id", F.lit("distribution").alias("aspect")))
    names = [(name, c) for _, name, domains in tables for c in domains]
    return every.select(_pick([t for t, _ in names]).alias("table_name"), _pick([c for _, c in names]).alias("column_name"), "load_id", "aspect")


def profile(df: DataFrame, table_name: str, loads: DataFrame, load: str, row_id: str, domains: Domains) -> DataFrame:
    """The base aggregates of every load and column, the shares of nulls of the load and the preceding one, and the largest difference of their distributions."""
    pairs = preceding(loads)
    weighted = weighted_of(counted([(df, domains)], load, row_id), [domains])
    stats = with_preceding(base(weighted), pairs)
    every = pairs.select("load_id", F.explode(F.array(*[F.lit(i) for i in range(len(domains))])).alias("kind"))
    moved = largest_difference(weighted, _binned(weighted, _sides(pairs)), every, pairs).select("load_id", _pick(list(domains)).alias("column_name"), (F.col("diff") / F.col("of")).cast("double").alias("largest_difference"))
    shares = stats.withColumn("null_share", F.col("n_null") / F.col("n_rows")).withColumn("prev_null_share", F.col("prev_n_null") / F.col("prev_n_rows"))
    return shares.join(moved, ["load_id", "column_name"], "left").withColumn("table_name", F.lit(table_name))
