"""Token counts with a digest cache.

Each text has a digest (128 bits and its length); the cache is a Parquet folder of (tokenizer digest, text digest, count). Counts
of known digests are joined. Of the others one document each is encoded, and its count appended to the cache before the join.
The tokenizer digest is that of the vocabulary file and the library's version, so that a new version never meets old counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import own_folder
from .common import cut, tidy
from .sentencepieces import tokenizer_path

CACHE = "version string, hi long, lo long, size long, n_tokens long"


def version(name: str) -> str:
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if name.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by the file's own library; one for each Python worker."""
    if name not in _counters:
        path = tokenizer_path(name)
        if name.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[name] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _counters[name] = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    return _counters[name]


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = F.md5(text.cast("binary"))
    half = lambda at: F.conv(F.substring(raw, at, 16), 16, -10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), half(1).alias("hi"), half(17).alias("lo"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, empty where there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model", cache: str | None = None, most: int = 4096) -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_tokens, over_limit).

    Counts are the library's for the whole text, without begin, end or added special tokens; strings of special tokens inside a
    text are handled as the library does by default. A null text counts as an empty one. Equal texts are encoded once, whatever
    their doc_id, null ones included. Where few texts are misses their keys are broadcast and no text moves but these; otherwise texts are
    dealt out once. over_limit: more than `most` tokens.
    cache: the folder to read and append; without one, an empty one is begun in the application's folder, which goes with it, and all distinct texts are misses.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    cache = cache or own_folder(spark, "token-counts")
    mine = version(name)
    key = ["hi", "lo", "size"]
    rows = _digested(docs)
    light = cut(rows.drop("text"), "digests")
    known = read_cache(spark, cache).filter(F.col("version") == mine)
    missed = cut(light.groupBy(*key).agg(F.min("doc_id").alias("doc_id")).join(known, key, "left_anti"), "misses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(count(part.column(3).to_pylist()), pa.int64())], [*key, "n_tokens"])
        tidy()

    ids = F.coalesce("doc_id", F.lit(-(1 << 63)))
    wanted = missed.select(ids.alias("k"), *key)
    texts = rows.withColumn("k", ids).join(wanted, ["k", *key], "left_semi")
    new = texts.select(*key, "text").mapInArrow(run, "hi long, lo long, size long, n_tokens long")
    new.distinct().select(F.lit(mine).alias("version"), *key, "n_tokens").write.mode("append").parquet(cache)
    stored = read_cache(spark, cache).filter(F.col("version") == mine).groupBy(*key).agg(F.max("n_tokens").alias("n_tokens"))
    other = lambda df: df.withColumn("j", F.col("hi").bitwiseXOR(F.lit(1))).drop("hi")  # noqa: E731  dealt anew, so that very common texts can be split
    out = other(light).join(other(stored), ["j", "lo", "size"])
    return out.select("doc_id", F.col("size").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))
