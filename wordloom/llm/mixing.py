"""Mixing sources to target weights by Pareto order sampling.  Column and SQL
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written
from .registry import register

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows of one source that are ranked together where its sample ends.
CUT_ROWS = 20_000
#: Up to this many sources, tables of a row per source are sent to all executors.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text") -> Column:
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def random_unit(*columns: str) -> Column:
    """A number in (0, 1) fixed by the row's values: 52 bits of an MD5."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return (F.conv(F.substring(F.md5(row), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def water_filled(sources: DataFrame, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) -> also target: the total size shared by weight,
    weights repeating over the sources in code point order, null last; a target
    stops at ``most`` times its source's size and the excess is shared again by
    weight among the rest.  The limit of that sharing is min(most * size,
    level * weight) with one level: sources full at it are those of least
    size per weight, so running sums over that order find it.  The windows
    run over one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array([F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))))
    s = s.withColumn("level", level)
    # the first source whose cap is above the level that its forerunners leave
    open_level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(
        F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return s.withColumn("target", F.least("cap", F.coalesce(open_level * F.col("w"), F.lit(0.0)))) \
        .select("source", "source_size", "target")


def pareto_mix(docs: DataFrame, targets: DataFrame, size: str, source: str, key: Column) -> DataFrame:
    """``docs`` with source_size, target, copies and taken (copies * size).
    ``docs`` should hold keys and sizes only: it is written twice.

    A source with target t and size s wants r = t / s copies of each of its
    documents: floor(r) are certain, the rest p = r - floor(r) is the
    inclusion chance of one more.  Documents are ranked by random odds over
    inclusion odds, u/(1-u) / (p/(1-p)), and taken in that order until the next
    would pass the source's remaining words; then the largest document that
    still fits fills the gap.  ``key`` gives u in (0, 1) from the row's values:
    repeated rows tie and are interchangeable, so reruns agree.

    Rank order is cut without sorting a source in one task: u is cut into
    ranges of about CUT_ROWS rows, sums of ranges find the range in which the
    sample ends, and only that one is ranked row by row.

    Null sources are a source of their own; null or empty texts have size 0
    and are taken 0 times their size; an empty table gives no rows."""
    new = {"source_size", "target", "copies", "taken"}
    kept = [c for c in docs.columns if c.lower() not in new]
    has_id = "doc_id" in docs.columns
    n = docs.count()
    slices = max(64, n // CUT_ROWS)
    t = targets.select(
        F.col("source").alias("t_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"))
    small = F.broadcast if targets.count() <= BROADCAST_SOURCES else (lambda df: df)
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    t = t.withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    # the caller's columns travel in one column, so that their names meet no other
    d = docs.select(F.struct(*kept).alias("row"), F.col(size).alias("size"), F.col(source).alias("source"), key.alias("u"),
                    (F.col("doc_id") if has_id else F.lit(0)).alias("id"))
    d = (d.join(small(t), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
         # random odds over inclusion odds; no chance ranks last
         .withColumn("odds", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")))
         .withColumn("slice", F.floor(F.col("u") * slices)))
    d = written(d, "ranks")
    sums = d.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut = (cut.where("before + words > rest").groupBy("source")
           .agg(F.min(F.struct(F.col("slice").alias("s"), F.col("before").alias("b"))).alias("c"))
           .select(F.col("source").alias("cut_source"), F.col("c.s").alias("cut"), F.col("c.b").alias("cut_before")))
    d = d.join(small(cut), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    inside = d.where(F.col("slice") == F.col("cut"))
    w = Window.partitionBy("source").orderBy("odds", "size", "id")
    inside = inside.withColumn("sum", F.col("cut_before") + F.sum("size").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    outside = d.where(F.col("cut").isNull() | (F.col("slice") != F.col("cut"))).withColumn("sum", F.lit(None).cast("long"))
    chosen = (F.col("p") > 0) & (F.col("cut").isNull() | (F.col("slice") < F.col("cut"))
                                 | ((F.col("slice") == F.col("cut")) & (F.col("sum") <= F.col("rest"))))
    ranked = written(inside.unionByName(outside).withColumn("in", F.coalesce(chosen, F.lit(False))), "ranked")
    # the gap that is left, and the largest unchosen document that fits it
    left = (ranked.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))).alias("gap"))
            .withColumnRenamed("source", "gap_source"))
    open_rows = ranked.where(~F.col("in") & (F.col("p") > 0) & (F.col("size") > 0)).join(
        small(left), F.col("source").eqNullSafe(F.col("gap_source"))).where(F.col("size") <= F.col("gap"))
    filler = (open_rows.groupBy("source").agg(F.max(F.struct(F.col("size").alias("z"), (-F.col("u")).alias("u"), "id")).alias("fill"))
              .withColumnRenamed("source", "fill_source"))
    out = ranked.join(small(filler), F.col("source").eqNullSafe(F.col("fill_source")), "left")
    # of repeated rows that tie for the gap only the first fills it
    ties = Window.partitionBy("source", "size", "u", "id").orderBy(F.lit(1))
    match = ((F.col("size") == F.col("fill.z")) & (-F.col("u") == F.col("fill.u")) & F.col("id").eqNullSafe(F.col("fill.id"))
             & ~F.col("in"))
    fits = F.coalesce(match, F.lit(False))
    hit = out.where(fits).withColumn("tie", F.row_number().over(ties))
    out = out.where(~fits).withColumn("tie", F.lit(0)).unionByName(hit)
    copies = F.col("whole") + (F.col("in") | (F.col("tie") == 1)).cast("long")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "source_size", "target",
                      copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source",
                  name: str = "_size") -> DataFrame:
    """Documents with size (words), source_size, target, copies and taken."""
    sized = docs.select([c for c in docs.columns if c.lower() != name.lower()] + [word_count(text).alias(name)])
    sources = sized.groupBy(F.col(source).alias("source")).agg(F.sum(name).alias("source_size"))
    return pareto_mix(sized, written(water_filled(sources), "targets"), name, source, random_unit("doc_id", source, name))


_SQL = r"""
with s as (select doc_id, source, (case when text is null then 0
    else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end)::bigint as size from documents),
w as (select source, source_size, (3 * source_size)::double as cap,
    ([1, 2, 3][(row_number() over (order by source is null, source) - 1) % 3 + 1])::double as w
    from (select source, sum(size)::bigint as source_size from s group by source)),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over earlier, 0))
      / (sum(w) over () - coalesce(sum(w) over earlier, 0)) as level from w
    window earlier as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
o as (select level from l where cap / w >= level order by cap / w, source is null, source limit 1),
t as (select source, source_size, least(cap, coalesce((select level from o), 0) * w) as target from l),
p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
d as (select s.*, source_size, target, whole, target - whole * source_size as rest,
    (('0x' || substr(md5(concat_ws('|', coalesce(s.doc_id::varchar, '~'), coalesce(s.source, '~'), s.size::varchar)), 1, 13))::bigint::double + 0.5)
      / 4503599627370496::double as u from s join p on s.source is not distinct from p.source),
c as (select *, rest > 0 and sum(size) over (partition by source order by u, size, doc_id rows unbounded preceding) <= rest as chosen from d),
g as (select *, rest - sum(case when chosen then size else 0 end) over (partition by source) as gap from c),
f as (select *, row_number() over (partition by source, not chosen and rest > 0 and size > 0 and size <= gap
    order by size desc, u, doc_id desc) as nth from g)
select doc_id, size, source_size, target, (size * (whole + (chosen or (rest > 0 and size > 0 and size <= gap and nth = 1))::bigint))::bigint as taken
from f
"""


@register("op7_mixing", _SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    docs = written(docs, "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    return pareto_mix(docs, written(water_filled(sources), "targets"), "size", "source",
                      random_unit("doc_id", "source", "size")).select(
        "doc_id", "size", "source_size", "target", "taken")
