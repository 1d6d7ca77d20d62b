"""Mixing of sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.llm.common import WORD, bounded, stored, unit_hash

#: Hash seeds that each source tries; it takes the one whose draws come nearest its target.
SEEDS = 16
#: A source list of at most this many rows is broadcast; a longer one is joined by shuffle.
SMALL_SOURCES = 50_000


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Target size of each source from rows (_source, _size).

    Sources in code point order, null last, take the weights in turn and share the whole
    size by them. No target exceeds ``most`` times its source's size: what is above is
    shared again by weight among the others. That is ``least(most * size, level * weight)``
    for one common level, found over the sources ordered by the level they fill up at.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = W.orderBy(F.col("_source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    fill = F.col("source_size") * float(most) / F.col("_weight")
    filled = W.orderBy("_fill", F.col("_source").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    here = filled.rowsBetween(W.currentRow, W.unboundedFollowing)
    levels = (
        per.withColumn("_weight", weight)
        .withColumn("_fill", fill)
        .withColumn("_total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("_spent", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(most))
        .withColumn("_open", F.sum("_weight").over(here))
        .withColumn("_level", (F.col("_total") - F.col("_spent")) / F.col("_open"))
    )
    # the level is that of the first source which does not fill up
    level = F.coalesce(
        F.first(F.when(F.col("_level") <= F.col("_fill"), F.col("_level")), True).over(
            filled.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        ),
        F.max("_fill").over(W.partitionBy()),
    )
    capped = F.col("source_size") * float(most)
    return (
        levels.withColumn("_at", level)
        .withColumn("target", F.least(capped, F.col("_at") * F.col("_weight")))
        .withColumn(
            "rate",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
        )
        .select("_source", "source_size", "target", "rate")
    )


def draws(key: Column, size: Column, rate: Column, seed: Column) -> Column:
    """Whether a document is taken once more: a number seeded by its key and size falls
    below the fraction of its source's rate."""
    return unit_hash(seed, key, size) < rate - F.floor(rate)


def seeded(sized: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """``rates`` with the seed of each source. Every document's draw has the probability of
    the fraction under any seed; trying some keeps a source's sum near its target."""
    key, size, rate = F.col("_key"), F.col("_size"), F.col("rate")
    joined = sized.join(bounded(rates, SMALL_SOURCES), sized["_source"].eqNullSafe(rates["_from"]))
    numbers = range(seed, seed + SEEDS)
    sums = joined.groupBy("_from").agg(
        *[F.sum(F.when(draws(key, size, rate, F.lit(i)), size).otherwise(0)).alias(f"_sum{i}") for i in numbers]
    )
    both = rates.join(sums.withColumnRenamed("_from", "_same"), F.col("_from").eqNullSafe(F.col("_same")))
    taken = F.floor("rate") * F.col("source_size")
    misses = [F.struct(F.abs(taken + F.col(f"_sum{i}") - F.col("target")).alias("miss"), F.lit(i).alias("seed")) for i in numbers]
    return both.withColumn("seed", F.array_min(F.array(*misses))["seed"]).select(*rates.columns, "seed")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 7,
    prefix: str = "mix_",
) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies behind ``prefix``.

    A document is taken floor(rate) times and once more if a number seeded by its key and
    size falls below the fraction. Null text has size 0; null sources form one source;
    rows of one key and size share their draw; an empty table stays empty. Columns of
    ``docs`` keep their names and values; the new names must not be among them
    (``common.unused`` finds a prefix). Reruns agree.
    """
    sized = stored(
        docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), words(F.col(text)).alias("_size")), "mix-sizes"
    )
    rates = stored(targets(sized, weights, most).withColumnRenamed("_source", "_from"), "mix-targets")
    table = stored(seeded(sized, rates, seed), "mix-seeds")
    lookup = table.select(*[F.col(c).alias(prefix + c.strip("_")) for c in table.columns])
    data = docs.withColumn(f"{prefix}size", words(F.col(text)))
    same = F.col(f"`{source}`").eqNullSafe(F.col(f"{prefix}from"))
    joined = data.join(bounded(lookup, SMALL_SOURCES), same, "left")
    rate = F.col(f"{prefix}rate")
    extra = draws(F.col(key), F.col(f"{prefix}size"), rate, F.col(f"{prefix}seed")).cast("int")
    counted = joined.withColumn(f"{prefix}copies", (F.floor(rate) + extra).cast("int"))
    return counted.drop(f"{prefix}from", f"{prefix}seed")


def emit(mixed: DataFrame, prefix: str = "mix_") -> DataFrame:
    """Each row of ``mix`` as often as it was taken, without the columns of ``prefix``."""
    kept = [c for c in mixed.columns if not c.startswith(prefix)]
    return (
        mixed.filter(f"{prefix}copies > 0")
        .withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1), F.col(f"{prefix}copies"))))
        .select(*[F.col(f"`{c}`") for c in kept])
    )


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [1.0::double, 2.0::double, 3.0::double][
        ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
f as (select *, source_size * 3.0::double / weight as fill, sum(source_size) over () as total from w),
l as (select *, (total::double - coalesce(sum(source_size) over (order by fill, source nulls last
        rows between unbounded preceding and 1 preceding), 0)::double * 3.0::double)
      / sum(weight) over (order by fill, source nulls last
        rows between current row and unbounded following) as level from f),
c as (select coalesce((select arg_min(level, fill) from l where level <= fill),
        (select max(fill) from l)) as level),
t as (select l.source, source_size, least(source_size * 3.0::double, c.level * weight) as target from l, c),
r as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from t),
u as (select d.*, source_size, target, rate, seed,
    '0x' || substr(md5(seed::varchar || '|' || coalesce(doc_id::varchar, '') || '|' || size::varchar), 1, 13) as hex
  from d join r on d.source is not distinct from r.source, (select unnest(range(7, 23)) as seed)),
e as (select *, case when hex::ubigint::double / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end as extra from u),
m as (select source, seed, abs(floor(any_value(rate)) * any_value(source_size) + sum(size * extra) - any_value(target)) as miss
  from e group by source, seed),
b as (select source, seed from (select *, row_number() over (partition by source order by miss, seed) as n from m) where n = 1)
select doc_id, size, source_size, target, (size * (floor(rate) + extra))::bigint as taken
from e join b on e.source is not distinct from b.source and e.seed = b.seed
"""
