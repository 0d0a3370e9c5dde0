"""Sharding along a Hilbert curve, with DataFrame functions only.

Source, language and size are quantised to 4 bits each; the curve index of the cell orders the rows, and runs of equal row count
are cut from that order, so that each shard covers a compact box of the three dimensions and readers can skip files on any of
them. Equal texts are one group: they take the metadata of the group's first row and stand together on the curve, so that only a
cut that the equal counts force can part them.

A row's place comes from counts of cells, of digest ranges within cells, of groups, and of salts within groups; only counts are
gathered by these keys. A group that holds a third of all rows is spread over 256 salts, digits of a digest of doc_id.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

BITS = 4


def hilbert(point: tuple[int, ...], bits: int = BITS) -> int:
    """Index along the Hilbert curve of a point with so many bits per dimension (Skilling, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] ^ t) >> b & 1
    return index


def _curve() -> list[int]:
    """The index of each cell, cells in order of their coordinates."""
    return [hilbert(p) for p in product(range(1 << BITS), repeat=3)]


def _levels(rows: DataFrame, name: str) -> list[str]:
    """At most 2**BITS values that cut the distinct values of a text column into runs of about equal number.

    All distinct values are sorted by range and numbered within their partitions. The driver gets the partitions' counts, which
    tell where each wanted rank is, and the values at those ranks.
    """
    values = rows.filter(F.col(name).isNotNull()).select(F.col(name).alias("v")).distinct().orderBy("v")
    values = cut(values.select("v", F.monotonically_increasing_id().alias("at")), name)  # partition << 33 | number in it
    parts = sorted((r.part, r.n) for r in values.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in parts)
    ranks, wanted, before = sorted({total * i >> BITS for i in range(1 << BITS)}), [], 0  # fewer values than levels: each
    for part, n in parts:
        wanted += [part << 33 | r - before for r in ranks if before <= r < before + n]
        before += n
    found = sorted((r.at, r.v) for r in values.filter(F.col("at").isin(wanted)).collect())
    drop_cut(values)
    return [v for _, v in found]


def _level(value: Column, levels: list[str]) -> Column:
    above = sum((F.when(value >= F.lit(x), 1).otherwise(0) for x in levels[1:]), F.lit(0))
    return F.when(value.isNull(), F.lit(0)).otherwise(above)


def shards(docs: DataFrame, n: int = 24) -> DataFrame:
    """One row per row of docs: (doc_id, size, text_crc32, law, shard, slot, grown_shard, curve).

    The law is `rows`: row counts of the n shards differ by one at most. Size is the text's UTF-8 bytes and 8. A null text has no
    bytes and the CRC of the empty text, and groups with empty ones. Null source or language count as the lowest level. Ties go to
    the smaller doc_id, null first; rows alike in doc_id and text change places without effect. Empty tables give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long").alias("digest"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.monotonically_increasing_id().cast("string"))).cast("binary")), 1, 2).alias("salt"),
    )
    rows = cut(rows, "rows")
    total = rows.count()
    sources, langs = _levels(rows, "source"), _levels(rows, "lang")
    group = ["digest", "crc", "size"]
    salted = rows.groupBy(*group, "salt").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "source", "lang")).alias("first"))
    groups = salted.groupBy(*group).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    side, curve = 1 << BITS, _curve()
    by_size = F.least(F.length(F.bin(F.col("size"))) - 4, F.lit(side - 1))  # the least size has 4 bits
    cell = (_level(F.col("first.source"), sources) * side + _level(F.col("first.lang"), langs)) * side + by_size
    groups = groups.select(*group, "n", F.element_at(F.lit(curve), (cell + 1).cast("int")).alias("curve"), F.shiftrightunsigned("digest", 54).alias("sub"))
    upto = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    groups = cut(groups.withColumn("in_sub", before(upto(["curve", "sub"], *group))), "groups")
    subs = groups.groupBy("curve", "sub").agg(F.sum("n").alias("n"))
    cells = subs.groupBy("curve").agg(F.sum("n").alias("n")).select("curve", before(upto([], "curve")).alias("in_all"))  # 4096 rows at most
    subs = subs.select("curve", "sub", before(upto(["curve"], "sub")).alias("in_cell")).join(cells, "curve")
    groups = groups.join(subs, ["curve", "sub"]).select(*group, "curve", (F.col("in_all") + F.col("in_cell") + F.col("in_sub")).alias("at"))
    base = salted.select(*group, "salt", before(upto(group, "salt")).alias("in_group")).join(groups, group)
    base = base.select(*group, "salt", "curve", (F.col("at") + F.col("in_group")).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy(*group, "salt").orderBy("doc_id")) - 1
    shard = F.expr(f"(place * {n}) div {max(total, 1)}")
    out = rows.join(base, [*group, "salt"]).withColumn("place", place).withColumn("shard", shard)
    slot = F.col("place") - F.expr(f"(shard * {total} + {n - 1}) div {n}")
    return out.select("doc_id", "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def _level_sql(name: str) -> str:
    edges = f"(SELECT CASE WHEN len(l) >= {1 << BITS} THEN list_transform(range({1 << BITS}), lambda i: l[len(l) * i // {1 << BITS} + 1]) ELSE l END FROM (SELECT list(v ORDER BY v) AS l FROM (SELECT DISTINCT {name} AS v FROM documents WHERE {name} IS NOT NULL)))"
    return f"CASE WHEN {name} IS NULL THEN 0 ELSE len(list_filter({edges}[2:], lambda e: e <= {name})) END"


def shards_sql(n: int = 24) -> str:
    """The same rows, without the curve; CRC-32 is the one of its definition, byte by byte."""
    nibble = "(strpos('0123456789ABCDEF', {}) - 1)"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents),
f AS (SELECT text, source, lang, strlen(text) + 8 AS size, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM d),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ({nibble.format("h[1]")} * 16 + {nibble.format("h[2]")})::BIGINT) AS bytes FROM f WHERE nth = 1),
g AS (SELECT text, size, md5(text) AS digest, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS crc,
  {_curve()}[({_level_sql("source")} * {1 << BITS} + {_level_sql("lang")}) * {1 << BITS} + least(length(bin(size)) - 4, {(1 << BITS) - 1}) + 1] AS curve FROM b, crc),
p AS (SELECT doc_id, size, crc, curve, row_number() OVER (ORDER BY curve, left(digest, 16), crc, size, left(md5(doc_id::VARCHAR), 2), doc_id) - 1 AS place, count(*) OVER () AS total FROM d JOIN g USING (text))
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (place * {n} // total)::INT AS shard, (place - (place * {n} // total * total + {n - 1}) // {n})::BIGINT AS slot, NULL::INT AS grown_shard, curve::INT AS curve FROM p
"""
