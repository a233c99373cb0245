"""Per-group ranking on logits: softmax (W3), top-k (W2), nucleus (W1),
categorical draw (W4), masked cross-entropy (A9); latest per group (W7),
running totals (W8).

Two logits layouts are supported:

* array form ``(row_id, logits ARRAY<FLOAT>)`` - one group is one row, so
  every operator is row-local (higher-order functions, no shuffle).  Running
  sums are a single ``aggregate`` fold with a struct accumulator, never an
  array rebuilt element by element.
* long form ``(row_id, token_id, logit)`` - window functions partitioned by
  the row (one shuffle on the row key; a group is one vocabulary, bounded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.binding import bind

NEG_INF = float("-inf")


def _dbl(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


# A scalar that every element needs (a maximum, a sum, the k-th value) is bound
# once per row, so the work grows with the row's width and not with its square.

# W3 -------------------------------------------------------------------------
def softmax(logits: Column, temperature: float = 1.0) -> Column:
    t = F.lit(float(temperature))
    scaled = F.transform(logits, lambda v: v.cast("double") / t)
    return bind(scaled, lambda x: bind(F.array_max(x), lambda m: bind(
        F.transform(x, lambda v: F.exp(v - m)), lambda e: bind(
            F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s)))))


def add_softmax(df: DataFrame, logits: str, out: str = "probs",
                temperature: float = 1.0) -> DataFrame:
    """Adds ARRAY<DOUBLE> probabilities of each logits row."""
    return df.withColumn(out, softmax(F.col(logits), temperature))


def add_log_sum_exp(df: DataFrame, logits: str, out: str = "lse") -> DataFrame:
    return df.withColumn(out, bind(_dbl(F.col(logits)), lambda x: bind(
        F.array_max(x), lambda m: m + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - m))))))


def _sorted_desc(values: Column) -> Column:
    """ARRAY<STRUCT<nv, i>> ordered by value desc, then index asc: a plain
    ``sort_array`` of (-value, index) structs, no comparator lambda."""
    z = F.transform(values, lambda v, i: F.struct((-v).alias("nv"), i.alias("i")))
    return F.sort_array(z)


# W2 -------------------------------------------------------------------------
def add_top_k(df: DataFrame, logits: str, k: int, out: str = "filtered") -> DataFrame:
    """Logits below the k-th largest become -inf (ties with it are kept);
    k larger than the row keeps everything."""
    def kth(x):
        return F.element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)))
    return df.withColumn(out, bind(_dbl(F.col(logits)), lambda x: bind(kth(x), lambda low: F.transform(
        x, lambda v: F.when(v < low, F.lit(NEG_INF)).otherwise(v)))))


# W1 -------------------------------------------------------------------------
def add_top_p(df: DataFrame, logits: str, p: float, temperature: float = 1.0,
              out: str = "filtered") -> DataFrame:
    """Nucleus filter: in descending probability order (ties by index) an item
    is kept while the summed probability of the items before it is <= p; the
    first is always kept.  The kept items are a prefix of the sorted order:
    one fold finds the last of them, and an item is kept if it is not after
    that one."""
    def last(ranked):
        none = F.struct(F.lit(0.0).alias("nv"), F.lit(-1).alias("i"))
        return F.aggregate(ranked, F.struct(F.lit(0.0).alias("cum"), none.alias("last")), lambda a, e: F.struct(
            (a["cum"] - e["nv"]).alias("cum"),
            F.when((a["cum"] <= F.lit(p)) | (a["last"]["i"] < 0), e).otherwise(a["last"]).alias("last")))["last"]

    def keep(probs, x, end):
        return F.transform(x, lambda v, i: F.when(
            (-F.get(probs, i) < end["nv"]) | ((-F.get(probs, i) == end["nv"]) & (i <= end["i"])), v)
            .otherwise(F.lit(NEG_INF)))

    return df.withColumn(out, bind(softmax(F.col(logits), temperature), lambda probs: bind(
        last(_sorted_desc(probs)), lambda end: bind(_dbl(F.col(logits)), lambda x: keep(probs, x, end)))))


def kept_ids(filtered: Column) -> Column:
    """Indices of the entries that survived a filter (ascending)."""
    idx = F.transform(filtered, lambda v, i: F.when(v != F.lit(NEG_INF), i))
    return F.filter(idx, lambda i: i.isNotNull())


# W4 -------------------------------------------------------------------------
def add_categorical_draw(df: DataFrame, logits: str, row_key: str, seed: int,
                         temperature: float = 1.0, out: str = "token") -> DataFrame:
    """Index drawn from softmax(logits / T): the first index whose cumulative
    probability reaches a keyed uniform draw (repeatable, shuffle-free)."""
    def pick(probs, u):
        return F.aggregate(
            probs, F.struct(F.lit(0.0).alias("cum"), F.lit(-1).alias("pick"), F.lit(0).alias("i")),
            lambda a, v: F.struct((a["cum"] + v).alias("cum"),
                                  F.when((a["pick"] < 0) & (a["cum"] + v >= u), a["i"])
                                   .otherwise(a["pick"]).alias("pick"),
                                  (a["i"] + 1).alias("i")))["pick"]

    u = draws.uniform(seed, "draw", F.col(row_key))
    # rounding can leave the total a hair under u: then the last index
    return df.withColumn(out, bind(softmax(F.col(logits), temperature), lambda probs: bind(
        u, lambda x: bind(pick(probs, x), lambda k: F.when(k < 0, F.size(probs) - 1).otherwise(k)))))


# A9 -------------------------------------------------------------------------
def masked_cross_entropy(df: DataFrame, logits: str, label: str, pad: int = 0,
                         batch_col: str | None = None) -> DataFrame:
    """Mean of -log softmax(logits)[label] over rows whose label is not the pad
    id (label = 0-based index); with ``batch_col`` also the mean of per-batch
    means (the epoch figure)."""
    d = add_log_sum_exp(df.where(F.col(label) != F.lit(pad)), logits, "_lse")
    d = d.withColumn("_loss", F.col("_lse") - F.element_at(F.col(logits), F.col(label) + 1).cast("double"))
    if batch_col is None:
        return d.agg(F.avg("_loss").alias("loss_mean"))
    per_batch = d.groupBy(batch_col).agg(F.avg("_loss").alias("_bl"), F.sum("_loss").alias("_s"),
                                         F.count(F.lit(1)).alias("_n"))
    return per_batch.agg((F.sum("_s") / F.sum("_n")).alias("loss_mean"),
                         F.avg("_bl").alias("loss_batch_mean"))


# Long form (row_id, token_id, logit) -----------------------------------------
def explode_logits(df: DataFrame, row_col: str, logits: str) -> DataFrame:
    return df.select(row_col, F.posexplode(logits).alias("token_id", "logit"))


def softmax_long(df: DataFrame, row_col: str, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy(row_col)
    x = F.col("logit").cast("double") / F.lit(float(temperature))
    d = df.withColumn("_x", x).withColumn("_m", F.max("_x").over(w))
    d = d.withColumn("_e", F.exp(F.col("_x") - F.col("_m")))
    return d.withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_x", "_m", "_e")


def top_k_long(df: DataFrame, row_col: str, k: int) -> DataFrame:
    """W2 as a window: rank() <= k keeps ties (plans as WindowGroupLimit)."""
    w = Window.partitionBy(row_col).orderBy(F.desc("logit"))
    return df.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def top_p_long(df: DataFrame, row_col: str, p: float, temperature: float = 1.0) -> DataFrame:
    """W1 as a window: exclusive running sum of probabilities, ties broken by
    token id."""
    d = softmax_long(df, row_col, temperature)
    w = (Window.partitionBy(row_col).orderBy(F.desc("prob"), F.asc("token_id"))
         .rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("_before", F.coalesce(F.sum("prob").over(w), F.lit(0.0))) \
            .where(F.col("_before") <= F.lit(p)).drop("_before")


# W7 -------------------------------------------------------------------------
def latest_per_group(df: DataFrame, group_cols: list[str], order_col: str,
                     tie_col: str) -> DataFrame:
    """The newest row of each group (ties by ``tie_col`` desc).  ``max_by``
    over a struct is a plain aggregate: partial per partition, so a hot group
    never collects its rows in one task."""
    cols = [c for c in df.columns if c not in group_cols]
    key = F.struct(F.col(order_col), F.col(tie_col))
    agg = df.groupBy(*group_cols).agg(F.max_by(F.struct(*cols), key).alias("_r"))
    return agg.select(*group_cols, "_r.*")


# W8 -------------------------------------------------------------------------
def running_totals(df: DataFrame, group_col: str, order_col: str, value_col: str,
                   num_partitions: int | None = None) -> DataFrame:
    """Running item count and running sum of ``value_col`` per group, in
    ``order_col`` order.  Null groups are one group, null orders come first,
    null values count as nothing, and rows that tie are all kept (their order
    among one another is that of the checkpointed table).

    A plain ``Window.partitionBy(group)`` would put a hot group (a third of
    all rows) in one task.  Instead a distributed prefix sum: range-partition
    on (group, order) so a hot group spans many partitions; local running sums
    per (partition, group); per-(partition, group) totals - at most
    partitions x groups-in-partition rows - give each piece its offset from
    the pieces before it; offset + local sum is the answer.
    """
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, F.col(group_col), F.col(order_col))
                .withColumn("_pid", F.spark_partition_id())
                .checkpoint(eager=True))
    piece = Window.partitionBy("_pid", group_col).orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = (tagged.withColumn("_c", F.count(F.lit(1)).over(piece))
                   .withColumn("_s", F.sum(value_col).over(piece)))
    totals = tagged.groupBy("_pid", group_col).agg(F.count(F.lit(1)).alias("_tc"),
                                                    F.sum(value_col).alias("_ts"))
    before = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_pid").alias("_opid"), F.col(group_col).alias("_ogroup"),
                            F.coalesce(F.sum("_tc").over(before), F.lit(0)).alias("_oc"),
                            F.coalesce(F.sum("_ts").over(before), F.lit(0)).alias("_os"))
    same = (F.col("_pid") == F.col("_opid")) & F.col(group_col).eqNullSafe(F.col("_ogroup"))
    return (local.join(offsets, same)
            .withColumn("items_so_far", (F.col("_oc") + F.col("_c")).cast("bigint"))
            .withColumn("tokens_so_far", (F.col("_os") + F.coalesce("_s", F.lit(0))).cast("bigint"))
            .drop("_pid", "_c", "_s", "_oc", "_os", "_opid", "_ogroup"))
