"""Ranking inside groups: top-k per group and the ranked peer list.

``top_values`` finds each group's top n distinct values with their ranks in two
passes.  The first keeps a bounded state a group: values are dealt to ``CELLS``
cells by their hash and each cell keeps its maximum (partial maxima merge, so a
task hands on CELLS rows a group at most).  Maxima of different cells are
different values, so the n-th of them is a cutoff that the group's n-th value
cannot lie below.  The second pass counts the (group, value) pairs at or above
the cutoffs, few besides those wanted, and a window ranks the pairs.
``top_per_group`` joins them back to the rows, so all ties are there and tied
rows never meet in one task.

``ranked_peers`` (watch list): every row of every group gets its RANK by a
value (descending) and the id/columns of the next row in (value desc, id)
order.  A window alone would send a whole group to one task; here rows are cut
into buckets of bounded size along (group, value desc, id), ranked inside
(group, bucket), and what went before in the group is added:

* rank  = rows of the group in earlier buckets + local start of the value's run;
  the first run of a bucket that goes on from the bucket before starts there;
* lead  = local lead, else the first row of the group's next bucket.

The cuts form a tree: at most ``FAN`` cuts, literals of the plan, and below each
range between two of them at most as many again, found by Spark in a sample and
kept in a small table that joins by range.  The bucket-local ranks are written
once; the first and last row of each (group, bucket) that a cut splits, two
groups a bucket at most, give the offsets as prefix sums in a small table, which
joins back to the rows; beside few cuts (``FLAT_CUTS``) the offsets are literals, as
the cuts are, and nothing is joined.  A hot value is split by id, too.
``strategy="builtin"`` is the plain window that tests and the bench compare with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from loanscope.functions.expressions import OrderKey
from loanscope.operators.positional import FLAT_CUTS, TupleOrder, pick_cuts, sample_and_count, search, sql_literal, with_position
from loanscope.session import spool

# Least number of cells for each of the top n values, and of cells in all.
CELLS_PER_VALUE = 4
LEAST_CELLS = 64
# Buckets of ranked rows hold this many at least; cuts of one level of the tree, and sampled rows a cut.
LEAST_BUCKET = 16_384
FAN = 256
PER_CUT = 16
# Cuts below one range, at most: four times what is expected.
MOST_BELOW = 1024


def _cutoffs(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """(__cg, __cut): a value of each group that its n-th largest distinct value cannot lie below; none if it has few values."""
    cell = F.pmod(F.xxhash64(F.col(order)), F.lit(max(LEAST_CELLS, CELLS_PER_VALUE * n)))
    highest = (df.filter(F.col(order).isNotNull()).groupBy(F.col(group).alias("__cg"), cell.alias("__cell"))
               .agg(F.max(order).alias("__v")))
    place = F.row_number().over(Window.partitionBy("__cg").orderBy(F.col("__v").desc()))
    return highest.withColumn("__place", place).filter(F.col("__place") == n).select("__cg", F.col("__v").alias("__cut"))


def _above_cutoffs(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Rows of ``df`` that can hold one of their group's top n values."""
    cutoffs = spool(_cutoffs(df, group, order, n), "cutoffs")          # its size is known: Spark decides how to join
    kept = df.join(cutoffs, F.col(group).eqNullSafe(F.col("__cg")), "left")
    return kept.filter(F.col("__cut").isNull() | (F.col(order) >= F.col("__cut"))).select(*df.columns)


def top_values(df: DataFrame, group: str, order: str, n: int, aggs: list[Column] | None = None) -> DataFrame:
    """(group, value, dense_rank, rank, rows, *aggs) for each group's top n distinct values, NULL last."""
    names = [f"__a{i}" for i in range(len(aggs or []))]
    pairs = df.groupBy(group, order).agg(F.count(F.lit(1)).alias("__rows"), *[a.alias(nm) for a, nm in zip(aggs or [], names)])
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    top = pairs.withColumn("__dense", F.dense_rank().over(w)).filter(F.col("__dense") <= n)
    before = F.coalesce(F.sum("__rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top.withColumn("__rank", before + 1).withColumn("__dense", F.col("__dense").cast("bigint"))


def top_per_group(df: DataFrame, group: str, order: str, n: int = 3, *, out: str = "rank", dense: bool = True,
                  strategy: str = "values") -> DataFrame:
    """Rows whose (dense) rank by ``order`` descending within ``group`` is <= n.

    Ties share a rank, so more than n rows per group can qualify - all of them
    are returned, and tied rows never meet in one task.
    """
    if strategy == "builtin":
        w = Window.partitionBy(group).orderBy(F.col(order).desc())
        fn = F.dense_rank() if dense else F.rank()
        # Filter on the raw window output so Catalyst inserts WindowGroupLimit.
        return (df.withColumn(out, fn.over(w)).filter(F.col(out) <= n)
                .withColumn(out, F.col(out).cast("bigint")))
    if strategy != "values":
        raise ValueError(f"unknown strategy {strategy}")
    rows = _above_cutoffs(df, group, order, n)
    top = (top_values(rows, group, order, n).select(F.col(group).alias("__g"), F.col(order).alias("__v"),
                                                    F.col("__dense" if dense else "__rank").alias(out))
           .filter(F.col(out) <= n))
    same = F.col(group).eqNullSafe(F.col("__g")) & F.col(order).eqNullSafe(F.col("__v"))
    return rows.join(top, same).select(*df.columns, F.col(out).cast("bigint").alias(out))


def top_counts(df: DataFrame, group: str, order: str, n: int, aggs: list[Column]) -> DataFrame:
    """Rows of ``top_values`` with RANK <= n: counts of the top rows without the rows themselves."""
    return top_values(_above_cutoffs(df, group, order, n), group, order, n, aggs).filter(F.col("__rank") <= n)


def ranked_peers(df: DataFrame, group: str, value: str, tie: str, carry: tuple[str, ...] = (), *,
                 rank_name: str = "rank", next_prefix: str = "next_", strategy: str = "buckets",
                 rows_per_bucket: int | None = None, fan: int = FAN, per_cut: int = PER_CUT, seed: int = 41,
                 dense_name: str | None = None) -> DataFrame:
    """RANK by ``value`` desc within ``group`` plus the next row's tie/value/carry columns.

    Adds ``rank_name`` and ``next_<c>`` for c in (tie, value, *carry), and the
    DENSE_RANK as ``dense_name`` when given.  ``tie`` is a unique id.  Buckets hold
    about ``rows_per_bucket`` rows: LEAST_BUCKET, or one part in ``fan`` squared of
    all rows if that is more.  The input is read twice (count and sample, window).
    """
    lead_cols = [tie, value] + [c for c in carry if c not in (tie, value)]
    if strategy == "builtin":
        w_rank = Window.partitionBy(group).orderBy(F.col(value).desc())
        w_lead = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(tie).asc())
        out = df
        for c in lead_cols:
            out = out.withColumn(f"{next_prefix}{c}", F.lead(c).over(w_lead))
        if dense_name:
            out = out.withColumn(dense_name, F.dense_rank().over(w_rank).cast("bigint"))
        return out.withColumn(rank_name, F.rank().over(w_rank).cast("bigint"))
    if strategy != "buckets":
        raise ValueError(f"unknown strategy {strategy}")
    keys = [OrderKey(group, descending=True), OrderKey(value, descending=True), OrderKey(tie)]
    sample, n = sample_and_count(df, keys, fan * per_cut, by=tie, seed=seed)
    size = max(rows_per_bucket or LEAST_BUCKET, -(-n // (fan * fan)))
    placed = _placed(df, keys, sample, n, -(-n // size) - 1, fan, per_cut, seed)
    local = _local_ranks(placed, group, value, tie, lead_cols)
    if n > size:                                     # else there is no cut, and nothing before or behind a bucket
        local = spool(local, "ranked")
        offsets = _offsets(local, group, value, lead_cols)                   # two groups a bucket, fan squared buckets: bounded
        cuts = -(-n // size) - 1
        local = _told(local, offsets, group, cuts + 1) if cuts <= min(fan, FLAT_CUTS) else _joined(local, offsets, group)
    return _with_offsets(local, n > size, df.columns, lead_cols, rank_name, next_prefix, dense_name)


def _placed(df: DataFrame, keys: list[OrderKey], sample: list[tuple], n: int, n_cuts: int, fan: int, per_cut: int, seed: int) -> DataFrame:
    """``df`` with ``__bucket`` (increasing along the order of ``keys``) and ``__split``: whether a cut beside the row's bucket
    lies in the row's group (the first key)."""
    group = F.col(keys[0].name)
    order = TupleOrder(df, keys)
    top = max(0, min(n_cuts, fan))                         # an empty table has no cut
    cuts = pick_cuts(sample, top)
    below = (n_cuts - top) // (top + 1)
    placed = with_position(df, order, cuts, "__range", keep_cuts="__cut", one_expression=True)
    names, count = [f"__cut{i}" for i in range(len(keys))], F.lit(len(cuts))
    low, high = _cut_group("__cut0", F.col("__range"), count), _cut_group("__cut0", F.col("__range") + 1, count)
    bucket = F.col("__range").cast("bigint")
    if below > 0:
        target = (top + 1) * below * per_cut
        sub = spool(_sub_cuts(placed, keys, min(1.0, target / n), per_cut, seed + 1), "cuts")   # about (fan + 1) * below tuples
        most = sub.agg(F.max("__n")).first()[0] or 0
        subs, size = [f"__sub{i}" for i in range(len(keys))], F.coalesce("__n", F.lit(0))
        placed = search(placed.join(F.broadcast(sub), "__range", "left"), order, subs, most, "__place", size=size, one_expression=True)
        place = F.col("__place")
        low = F.when(place >= 1, _cut_group("__sub0", place, size)).otherwise(low)
        high = F.when(place < size, _cut_group("__sub0", place + 1, size)).otherwise(high)
        bucket, names = bucket * F.lit(MOST_BELOW) + place, [*names, *subs, "__place", "__n"]
    # A cut outside the list is a null struct: no group, not even the null group.
    split = (low.isNotNull() & low["g"].eqNullSafe(group)) | (high.isNotNull() & high["g"].eqNullSafe(group))
    return placed.withColumns({"__bucket": bucket, "__split": split}).drop("__range", *names)


def _cut_group(groups: str, place: Column, size: Column) -> Column:
    """The group of a cut as a struct, null where there is no cut of that number."""
    known = (place >= 1) & (place <= size)
    return F.when(known, F.struct(F.try_element_at(F.col(groups), F.greatest(place, F.lit(1))).alias("g")))


def _sub_cuts(placed: DataFrame, keys: list[OrderKey], fraction: float, per_cut: int, seed: int) -> DataFrame:
    """(__range, __n, __sub0, ...): every ``per_cut``-th row of a sample of each range, as arrays by key."""
    names = [k.name for k in keys]
    sample = placed.select("__range", *names).sample(withReplacement=False, fraction=fraction, seed=seed)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*[k.sort_col() for k in keys]))
    picked = (sample.withColumn("__place", place).filter((F.col("__place") % per_cut == 0) & (F.col("__place") < MOST_BELOW * per_cut))
              .groupBy("__range").agg(F.sort_array(F.collect_list(F.struct("__place", *names))).alias("__cuts")))
    return picked.select("__range", F.size("__cuts").alias("__n"), *[F.col("__cuts")[nm].alias(f"__sub{i}") for i, nm in enumerate(names)])


def _local_ranks(placed: DataFrame, group: str, value: str, tie: str, lead_cols: list[str]) -> DataFrame:
    """Inside (group, bucket): row number, start of the value's run, number of runs so far, next row."""
    w = Window.partitionBy(group, "__bucket").orderBy(F.col(value).desc(), F.col(tie).asc())
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (placed.withColumn("__rn", F.row_number().over(w).cast("bigint"))
             .withColumn("__prev", F.lag(value).over(w))
             .withColumn("__next", F.lead(F.struct(*lead_cols)).over(w)))
    starts = F.when((F.col("__rn") == 1) | ~F.col(value).eqNullSafe(F.col("__prev")), F.col("__rn"))
    return (local.withColumn("__start", starts).withColumn("__run", F.max("__start").over(w_run))
            .withColumn("__runs", F.count("__start").over(w_run)).drop("__prev", "__start"))


def _offsets(local: DataFrame, group: str, value: str, lead_cols: list[str]) -> DataFrame:
    """What (group, bucket) rows need from the group's other buckets, for the groups that cuts split.

    (__g, __b, before, runs_before, continued, run_start, first_of_next): rows and runs of earlier buckets, whether the
    bucket's first run goes on from the bucket before, that run's start in the group, the first row of the next bucket.
    """
    ends = local.filter(F.col("__split") & ((F.col("__rn") == 1) | F.col("__next").isNull())).repartition(group)
    first, last = F.col("__rn") == 1, F.col("__next").isNull()
    stats = ends.groupBy(F.col(group).alias("__g"), F.col("__bucket").alias("__b")).agg(
        F.first(F.when(first, F.struct(*lead_cols)), ignorenulls=True).alias("first"),
        F.first(F.when(last, F.struct(F.col("__rn").alias("rows"), F.col("__run").alias("run"), F.col("__runs").alias("runs"),
                                      F.col(value).alias("value"))), ignorenulls=True).alias("last"))
    w = Window.partitionBy("__g").orderBy("__b")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("previous", F.lag(F.struct(F.col("last.value").alias("value"))).over(w))
    stats = stats.withColumn("continued", F.coalesce(
        F.col("previous").isNotNull() & F.col("previous.value").eqNullSafe(F.col(f"first.{value}")), F.lit(False)))
    stats = stats.withColumn("before", F.coalesce(F.sum("last.rows").over(earlier), F.lit(0).cast("bigint")))
    stats = stats.withColumn("runs_before", F.coalesce(
        F.sum(F.col("last.runs") - F.col("continued").cast("bigint")).over(earlier), F.lit(0).cast("bigint")))
    # A bucket of one run that goes on has no start of its own.
    own = F.when(~(F.col("continued") & (F.col("last.run") == 1)), F.col("before") + F.col("last.run"))
    stats = stats.withColumn("started", F.last(own, ignorenulls=True).over(so_far))
    return stats.select("__g", "__b", "before", "runs_before", "continued", F.lag("started").over(w).alias("run_start"),
                        F.lead("first").over(w).alias("first_of_next"))


def _joined(local: DataFrame, offsets: DataFrame, group: str) -> DataFrame:
    """Rows with the offsets of their (group, bucket), if it has any."""
    return local.join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")), "left")


def _told(local: DataFrame, offsets: DataFrame, group: str, buckets: int) -> DataFrame:
    """The same by literals, an array entry a bucket: for the first group that has offsets in it, and for the second."""
    found: list[list[Row]] = [[] for _ in range(buckets)]
    for row in offsets.collect():
        found[row["__b"]].append(row)
    picked = F.lit(None).cast(offsets.schema)
    for place in range(max(map(len, found)) - 1, -1, -1):
        told = ", ".join(sql_literal(rows[place] if place < len(rows) else None, offsets.schema) for rows in found)
        entry = F.get(F.expr(f"array({told})"), F.col("__bucket").cast("int"))
        picked = F.when(entry.isNotNull() & entry["__g"].eqNullSafe(F.col(group)), entry).otherwise(picked)
    return local.withColumn("__offsets", picked).select(*local.columns, "__offsets.*")


def _with_offsets(rows: DataFrame, cut: bool, columns: list[str], lead_cols: list[str], rank_name: str, next_prefix: str,
                  dense_name: str | None) -> DataFrame:
    rank, dense, following = F.col("__run"), F.col("__runs"), F.col("__next")
    if cut:
        goes_on = F.coalesce(F.col("continued"), F.lit(False))
        rank = F.when(goes_on & (rank == 1), F.col("run_start")).otherwise(F.coalesce("before", F.lit(0)) + rank)
        dense = F.coalesce("runs_before", F.lit(0)) + dense - goes_on.cast("bigint")
        following = F.coalesce(following, "first_of_next")
    extra = [dense.cast("bigint").alias(dense_name)] if dense_name else []
    return rows.select(*columns, *[following[c].alias(f"{next_prefix}{c}") for c in lead_cols], rank.cast("bigint").alias(rank_name), *extra)
