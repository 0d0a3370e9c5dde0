"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document has the same expected number of copies, target / source size. Documents of a source stand in an
order near that of their sizes; the prefix sum of expected copies is the rank times that number, one random offset is added, and
a document is taken once for each whole number its own stretch crosses. As the order follows sizes, each stretch of sizes is
taken in proportion, and the words taken come near the target.

Ranks come from counts: of (source, size class, salt), summed up within the class and the source. Only counts meet per source;
documents meet in groups of one (source, size class, salt). The salt is a digest of the doc_id with as many digits as the number
of rows asks, so that a source with a third of all rows, in one size class, is spread over groups of GROUP rows or fewer.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, packed, unpacked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
#: Rows in a group, about, at which salts get another hexadecimal digit; two at least.
GROUP = 1 << 18
SEED = 42


def size_class(size: Column) -> Column:
    """Four classes for each power of two; whole-number arithmetic only."""
    bits = F.length(F.bin(size))
    return F.when(size <= 0, F.lit(0)).otherwise(bits * 4 + F.expr("cast(shiftright(size * 4, length(bin(size)) - 1) as int)") - 4)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(key, source_size long, target double) from rows (key, source, s): targets by weight, none over ceiling x its size.

    Sources take weights in code point order, null last. Filling up by rising ceiling / weight gives what resharing the excess
    until none is above gives: a source is full if its ceiling is at most its weight's share of what those before it leave.
    The rows here are the sources, one each.
    """
    total = sizes.groupBy("key", "source").agg(F.sum("s").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = total.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("want", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(every))
    w = w.withColumn("cap_b", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_b", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("full", F.col("cap") * (F.col("all_w") - F.col("w_b")) <= F.col("w") * (F.col("want") - F.col("cap_b")))
    w = w.withColumn("cap_f", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)).withColumn("w_f", F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(every))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * (F.col("want") - F.col("cap_f")) / (F.col("all_w") - F.col("w_f")))
    return w.select("key", "source_size", target.alias("target"))


def _sized(docs: DataFrame, digits: int) -> dict[str, Column]:
    """What mixing needs of a row: its id, a key that is the source but never null, its size, size class and salt."""
    source = F.col("source").cast("string")
    # null ids are told apart by their texts
    salt = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.xxhash64("text").cast("string"))).cast("binary")), 1, digits)
    return {"doc_id": F.col("doc_id").cast("long"), "source": source, "key": F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)), "size": n_words(F.col("text").cast("string")), "salt": salt}


def _digits(n: int) -> int:
    """Hexadecimal digits of a salt for n rows."""
    digits = 2
    while n > GROUP << (4 * digits) and digits < 8:
        digits += 1
    return digits


def with_copies(rows: DataFrame, seed: int = SEED, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, stats: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, source, key, size, salt, and others) with source_size, target and copies, how often the mix takes the row.

    stats: the same rows without the others, if reading them apart is cheaper.
    """
    key = ["key", "class", "salt"]
    classed = lambda df: df.withColumn("class", size_class(F.col("size")))
    groups = cut(classed(rows if stats is None else stats).groupBy("key", "source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "mix")
    by_class = groups.groupBy("key", "class").agg(F.sum("n").alias("n"))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_class = by_class.select("key", "class", F.coalesce(F.sum("n").over(upto("key", "class")), F.lit(0)).alias("of_class"))
    by_class = by_class.join(source_targets(groups, weights, share, ceiling), "key")
    base = groups.select(*key, F.coalesce(F.sum("n").over(upto(*key)), F.lit(0)).alias("of_salt"))
    base = base.join(by_class, ["key", "class"]).select(*key, (F.col("of_class") + F.col("of_salt")).alias("base"), "source_size", "target")
    rank = F.col("base") + F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "size"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = classed(rows).join(base, key).withColumn("rank", rank).withColumn("each", each)
    offset = F.lit(random.Random(seed).random())
    copies = F.floor(F.col("rank") * F.col("each") + offset) - F.floor((F.col("rank") - 1) * F.col("each") + offset)
    return out.withColumn("copies", copies.cast("int")).drop(*key, "base", "rank", "each")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of docs: (doc_id, size, source_size, target, taken).

    Size is the number of words, 0 for a null or blank text. A null source is a source of its own, last in order. No row is taken
    more than twice. A null doc_id stands first in its group; rows alike in doc_id, source and size change places without effect.
    Other columns, whatever their names, are not looked at. Empty tables give no rows; a source of size 0 has target 0.
    """
    sized = cut(docs.select(*(c.alias(n) for n, c in _sized(docs, _digits(docs.count())).items())), "sizes")
    return with_copies(sized, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: each row once for each copy, in the columns of docs, whatever the names of others than doc_id, text and source."""
    of = _sized(docs, _digits(docs.count()))
    out = with_copies(packed(docs, **of), seed, stats=docs.select(*(c.alias(n) for n, c in of.items())))
    return unpacked(out.where("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")), docs.columns)


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT source, source_size, ([5.0, 2.0, 1.0])[1 + (nth - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS want, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_b,
  coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_b FROM w),
f AS (SELECT *, cap * (all_w - w_b) <= w * (want - cap_b) AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * (want - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / (all_w - coalesce(sum(w) FILTER (is_full) OVER (), 0)) END AS target FROM f),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each_,
  row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 4 + ((size * 4) >> (length(bin(size)) - 1)) - 4 END, substr(md5(doc_id::VARCHAR), 1, 2), doc_id, size) AS rank_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (floor(rank_ * each_ + {random.Random(SEED).random()!r}::DOUBLE) - floor((rank_ - 1) * each_ + {random.Random(SEED).random()!r}::DOUBLE))::BIGINT * size AS taken FROM r
"""
