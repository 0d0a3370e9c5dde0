"""Columns of a table may have any name, those that operators use among themselves too: results and carried values are the same."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql.types import StringType, StructField, StructType
from sparkseek import llm
from sparkseek.llm import graph, hashing, lines, mixing, quality, sentencepieces, sharding, simhash, suffixes, tokencounts

SF = "/root/testdata/sf0.001"
OWN = {"doc_id", "text", "source", "lang", "n_chars", "vec_id", "label", "embedding"}


def names():
    """Every short string in the code of this subpackage that could be a column, and those of round 1's stages."""
    found = {"__k", "__key", "__salt", "__rank", "__copies", "__copy", "__size", "__spans", "__score", "__class", "__x", "c0", "c1", "a.b", "with space"}
    for f in Path(llm.__path__[0]).glob("*.py"):
        code = f.read_text()
        found |= set(re.findall(r'"([a-z_][a-z_0-9]{0,14})"', code)) | set(re.findall(r"\b([a-z_]{1,14}) (?:long|int|string|double|boolean|binary)\b", code))
    return sorted(found - OWN)


def widened(spark, table, n=120):
    """The first rows of a table, as they are and with a column of each name."""
    plain = spark.createDataFrame(spark.read.parquet(f"{SF}/{table}.parquet").orderBy(spark.read.parquet(f"{SF}/{table}.parquet").columns[0]).limit(n).collect())
    rows = [(*r, *([f"{r[0]} {c}" for c in names()])) for r in plain.collect()]
    return plain, spark.createDataFrame(rows, StructType([*plain.schema, *(StructField(c, StringType()) for c in names())]))


STAGES = {
    "good_ones": lambda spark, d: quality.good_ones(d, spark.read.parquet(f"{SF}/labels.parquet")), "keep_one": lambda spark, d: simhash.keep_one(d),
    "without_repeats": lambda spark, d: suffixes.without_repeats(d), "mixed": lambda spark, d: mixing.mixed(d),
}


@pytest.mark.parametrize("stage", STAGES)
def test_stages(spark, stage):
    plain, wide = widened(spark, "documents")
    out = STAGES[stage](spark, wide)
    assert out.columns == wide.columns and [f.dataType for f in out.schema] == [f.dataType for f in wide.schema]
    got = out.collect()
    assert all(r[len(plain.columns) + i] == f"{r.doc_id} {c}" for r in got for i, c in enumerate(names()))
    assert Counter(r[: len(plain.columns)] for r in map(tuple, got)) == Counter(map(tuple, STAGES[stage](spark, spark.createDataFrame(plain.collect(), plain.schema)).collect()))


OPERATORS = {
    "op1": ("documents", simhash.near_duplicates), "op2": ("documents", suffixes.repeated_spans), "op3": ("documents", mixing.mix), "op4": ("documents", sentencepieces.encoded), "op5": ("embeddings", hashing.nearest),
    "op6": ("documents", lines.dedup_lines), "op7": ("documents", tokencounts.token_counts), "op8": ("embeddings", graph.near_duplicates), "op10": ("documents", sharding.shards),
}


@pytest.mark.parametrize("op", OPERATORS)
def test_operators(spark, op):
    table, run = OPERATORS[op]
    plain, wide = widened(spark, table, 60)
    assert Counter(map(str, run(wide).collect())) == Counter(map(str, run(plain).collect()))
