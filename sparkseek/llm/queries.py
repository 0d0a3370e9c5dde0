"""The queries of this subpackage's operators, opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    rows = near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encoded

    return encoded(_table(spark, sf_dir, "documents"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans: 'start-end@first_doc_id' of each span that goes, in bytes of the text."""
    from .suffixes import repeated_spans

    each = F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"], F.lit("@"), F.coalesce(s["first_doc_id"].cast("string"), F.lit("null"))))
    return repeated_spans(_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_spans").cast("long").alias("n_spans"), "n_bytes", F.array_join(each, " ").alias("spans"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """removed: 'start-end@first_doc_id:first_unit' of each unit that goes, in characters of the original text."""
    from .lines import dedup_lines

    each = F.transform("removed", lambda s: F.concat(s["start"], F.lit("-"), s["end"], F.lit("@"), F.coalesce(s["first_doc_id"].cast("string"), F.lit("null")), F.lit(":"), s["first_unit"]))
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", F.col("n_units").cast("long").alias("n_units"), F.col("n_removed").cast("long").alias("n_removed"), F.array_join(each, " ").alias("removed"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op5_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hashing import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(_table(spark, sf_dir, "documents"))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def simhash_sql() -> str:
    """Fingerprints and components in SQL; XXH64 by its definition (seed 42), in 128-bit arithmetic modulo 2**64."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    m = "18446744073709551616::UHUGEINT"

    def rotated(x: str, by: int) -> str:
        return f"((({x}) * {1 << by}::UHUGEINT) % {m} + ({x}) // {1 << 64 - by}::UHUGEINT)"

    def number(at: str, size: int) -> str:  # little-endian
        return "(" + " + ".join(f"b[{at} + {j + 1}] * {256**j}::UHUGEINT" for j in range(size)) + ")"

    def rounds(lanes: str) -> str:  # what each lane of 8 bytes becomes before it is taken in
        return f"list_transform(list_transform({lanes}, lambda x: x * {p2} % {m}), lambda y: {rotated('y', 31)} * {p1} % {m})"

    def shaken(h: str, by: int, times: str = "") -> str:
        return f"xor({h}, {h} // {1 << by}::UHUGEINT){times and f' * {times} % {m}'}"

    states = ", ".join(f"{rotated(f'(v[{i}] + x[{i}] * {p2}) % {m}', 31)} * {p1} % {m}" for i in range(1, 5))
    begin = ", ".join(f"{(42 + x) % (1 << 64)}::UHUGEINT" for x in (11400714785074694791 + 14029467366897019727, 14029467366897019727, 0, -11400714785074694791))
    ones = ", ".join(f"sum(h >> {b} & 1)::BIGINT" for b in range(64))
    code = " + ".join(f"(CASE WHEN 2 * o[{b + 1}] > n THEN {1 << b} ELSE 0 END)::UHUGEINT" for b in range(64))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(greatest(1, len(w) - 2)), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS s FROM w WHERE len(w) > 0),
b AS (SELECT s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ((strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1)::UHUGEINT) AS b FROM (SELECT DISTINCT s FROM s)),
l AS (SELECT s, b, len(b) AS n, len(b) // 32 * 32 AS long, list_transform(range(len(b) // 32), lambda k: [{", ".join(number(f"k * 32 + {8 * i}", 8) for i in range(4))}]) AS stripes,
  list_transform(range(len(b) % 32 // 8), lambda k: {number("len(b) // 32 * 32 + k * 8", 8)}) AS eights FROM b),
v AS (SELECT *, CASE WHEN n >= 32 THEN list_reduce(list_prepend([{begin}], stripes), lambda v, x: [{states}]) END AS v FROM l),
h0 AS (SELECT *, ((CASE WHEN n < 32 THEN 42 + {p5} ELSE list_reduce(list_prepend(({" + ".join(rotated(f"v[{i}]", r) for i, r in ((1, 1), (2, 7), (3, 12), (4, 18)))}) % {m}, {rounds("v")}), lambda h, k: (xor(h, k) * {p1} + {p4}) % {m}) END) + n::UHUGEINT) % {m} AS h FROM v),
h1 AS (SELECT *, list_reduce(list_prepend(h, {rounds("eights")}), lambda h, k: ({rotated("xor(h, k)", 27)} * {p1} + {p4}) % {m}) AS h8 FROM h0),
h2 AS (SELECT *, CASE WHEN n % 8 >= 4 THEN ({rotated(f"xor(h8, {number('n // 8 * 8', 4)} * {p1} % {m})", 23)} * {p2} + {p3}) % {m} ELSE h8 END AS h4 FROM h1),
h3 AS (SELECT *, list_reduce(list_prepend(h4, list_transform(b[n // 4 * 4 + 1 :], lambda x: x * {p5} % {m})), lambda h, k: {rotated("xor(h, k)", 11)} * {p1} % {m}) AS h1 FROM h2),
h4 AS (SELECT s, {shaken("h1", 33, p2)} AS h FROM h3), h5 AS (SELECT s, {shaken("h", 29, p3)} AS h FROM h4), h6 AS (SELECT s, ({shaken("h", 32)})::UBIGINT AS h FROM h5),
o AS (SELECT doc_id, [{ones}] AS o, count(*) AS n FROM s JOIN h6 USING (s) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce({code}, 0)::UBIGINT AS fp FROM documents LEFT JOIN o USING (doc_id)),
c AS (SELECT fp, min(doc_id) AS head FROM f GROUP BY fp),
e AS (SELECT x.fp AS a, y.fp AS b FROM c x JOIN c y ON bit_count(xor(x.fp, y.fp)::BIT) <= 2),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS fp, min(head) AS component_id FROM r JOIN c ON r.b = c.fp GROUP BY a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN k USING (fp)
"""


SPANS_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS p FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM t),
v AS (SELECT doc_id, i, piece, coalesce(sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM u),
w AS (SELECT doc_id, start, start + strlen(piece) AS stop, {_FOLD.format("piece")} AS word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM v WHERE regexp_matches(piece, '^[^\x20\x09-\x0D]')),
x AS (SELECT doc_id, start, lead(stop, 49) OVER (PARTITION BY doc_id ORDER BY k) AS stop, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS words FROM w),
f AS (SELECT words, min({{'doc': doc_id, 'start': start}}) AS first FROM x WHERE stop IS NOT NULL GROUP BY words HAVING count(*) > 1),
g AS (SELECT doc_id, start, stop, first.doc AS first FROM x JOIN f USING (words) WHERE stop IS NOT NULL AND (doc_id <> first.doc OR start <> first.start)),
m AS (SELECT *, start > coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM g),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS span FROM m),
s AS (SELECT doc_id, min(start) AS a, max(stop) AS b, min(first) AS first FROM n GROUP BY doc_id, span)
SELECT d.doc_id, count(s.a)::BIGINT AS n_spans, coalesce(sum(b - a), 0)::BIGINT AS n_bytes, coalesce(string_agg(a || '-' || b || '@' || first, ' ' ORDER BY a), '') AS spans
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""

LINES_SQL = rf"""
WITH u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS unit FROM (SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:(?:[.!?][\x20\x09-\x0D]|\n)[\x20\x09-\x0D]*|$)') AS l FROM documents WHERE text IS NOT NULL)),
v AS (SELECT doc_id, unit, line, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, regexp_extract_all({_FOLD.format("line")}, '[^\x20\x09-\x0D]+') AS words FROM u WHERE line <> ''),
f AS (SELECT words, min({{'doc': doc_id, 'unit': unit}}) AS first FROM v WHERE len(words) > 0 GROUP BY words),
r AS (SELECT v.*, first, len(v.words) > 0 AND (doc_id <> first.doc OR unit <> first.unit) AS again FROM v LEFT JOIN f ON v.words = f.words),
i AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id, again ORDER BY unit) AS island FROM r),
k AS (SELECT *, again AND sum(greatest(len(words), length(line) // 10)) OVER (PARTITION BY doc_id, again, island) >= 30 AS gone FROM i)
SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, '' ORDER BY unit) FILTER (NOT gone), '') END AS text, count(unit)::BIGINT AS n_units, (count(*) FILTER (gone))::BIGINT AS n_removed,
  coalesce(string_agg(start || '-' || (start + length(line)) || '@' || first.doc || ':' || first.unit, ' ' ORDER BY unit) FILTER (gone), '') AS removed
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""

LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
l AS (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN l USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_suffixes, op3_mixing, op4_sentencepiece, op5_hashing, op6_lines, op7_token_counts, op8_graph, op9_quality, op10_sharding)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .mixing import MIX_SQL
    from .sharding import shards_sql

    return {"op1_simhash": simhash_sql(), "op2_suffixes": SPANS_SQL, "op3_mixing": MIX_SQL, "op6_lines": LINES_SQL, "op8_graph": LINKS_SQL, "op10_sharding": shards_sql()}
