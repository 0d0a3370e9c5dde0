"""Vectors: similarity as native expressions, exact nearest neighbours, and embeddings of text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


#: Dimensions up to which a similarity to a known vector is written out as one sum, which stays in generated code.
FLAT = 256


def cosine_to(v: Column, target: list[float]) -> Column:
    """Cosine with a known vector; null for a vector of another length."""
    parts = [F.get(v, F.lit(i)).cast("double") for i in range(len(target))]
    total = lambda terms: reduce(lambda a, b: a + b, terms, F.lit(0.0))
    length = F.sqrt(total([p * p for p in parts])) * F.lit(float(np.sqrt(sum(float(t) * float(t) for t in target))))
    return F.when((F.size(v) == len(target)) & (length > 0), total([p * F.lit(float(t)) for p, t in zip(parts, target)]) / length)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def knn(df: DataFrame, vector_col: str, target: list[float], k: int, id_col: str, where: Column | None = None) -> DataFrame:
    """The k rows most similar to the target, most similar first, ties by id; `where` is applied before."""
    rows = df if where is None else df.filter(where)
    near = cosine_to(F.col(vector_col), target) if len(target) <= FLAT else cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in target]))
    # a filter before the limit would go below the vectors, which are then made twice; nulls come last
    return rows.withColumn("similarity", near).orderBy(F.desc_nulls_last("similarity"), id_col).limit(k).filter("similarity is not null")


_fresh = hashlib.blake2b(digest_size=8).copy  # takes less than a new one with its parameters


def _digest(word: bytes) -> bytes:
    h = _fresh()
    h.update(word)
    return h.digest()


def hashing_embedding(text: str, size: int = 64) -> list[float]:
    """A deterministic embedding without a model: signed hashing of words and their pairs, unit length."""
    words = " ".join(text.lower().split()).encode().split()  # ASCII blanks alone are left
    found = [_digest(w) for w in words] + [_digest(a + b" " + b) for a, b in zip(words, words[1:])]
    h = np.frombuffer(b"".join(found), ">u8")
    out = np.bincount((h % size).astype(np.int64), np.where(h >> 63, 1.0, -1.0), size)
    length = np.linalg.norm(out)
    return (out / length if length else out).astype(np.float32).tolist()


#: Models by name: each makes an embedding function, once in each worker.
MODELS: dict[str, Callable[[], Callable[[str], list[float]]]] = {"hashing": lambda: hashing_embedding}


def register_model(name: str, make: Callable[[], Callable[[str], list[float]]]) -> None:
    MODELS[name] = make


def model_of(model: str | Callable | None) -> Callable[[], Callable[[str], list[float]]]:
    """A model by its name, or as it is handed in; without one, hashing of words."""
    if isinstance(model, str):
        if model not in MODELS:
            raise KeyError(f"no model {model!r}")
        return MODELS[model]
    return model or MODELS["hashing"]


def vectorize(col: Column, model: str | Callable | None = None, prefix: str = "", once: bool = False) -> Column:
    """array<float> of a text column. model: a name, or what makes the embedding function; once: filters stay above it."""
    make = model_of(model)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for s in batches:
            yield s.map(lambda t: None if t is None else embed(prefix + t))

    return (run.asNondeterministic() if once else run)(col)


def semantic_search(df: DataFrame, text_col: str, query: str, k: int, id_col: str, model=None, passage_prefix: str = "", query_prefix: str = "") -> DataFrame:
    """The k rows whose text is nearest to the query's, by embeddings made as they are needed; SemanticIndex keeps them."""
    target = model_of(model)()(query_prefix + query)
    return knn(df.withColumn("__v", vectorize(F.col(text_col), model, passage_prefix)), "__v", target, k, id_col).drop("__v")


class SemanticIndex:
    """Embeddings of a text column on disk, made once for each row, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, model: str | Callable | None = None, passage_prefix: str = "", query_prefix: str = ""):
        self.spark, self.path, self.model, self.passage_prefix, self.query_prefix = spark, path, model, passage_prefix, query_prefix

    def append(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Embed and keep more rows; null texts have no embedding."""
        rows = df.select(F.col(id_col).alias("doc_id"), vectorize(F.col(text_col), self.model, self.passage_prefix, once=True).alias("v"))
        rows.filter("v is not null").write.mode("append").parquet(self.path)

    def search(self, query: str, k: int, where: DataFrame | None = None) -> DataFrame:
        """(doc_id, similarity) of the k nearest, nearest first, ties by doc_id; where: the doc_id to search among."""
        rows = self.spark.read.parquet(self.path)
        rows = rows if where is None else rows.join(where.select("doc_id"), "doc_id", "left_semi")
        return knn(rows, "v", model_of(self.model)()(self.query_prefix + query), k, "doc_id").select("doc_id", "similarity")
