"""Token indexes on disk: segments of postings in Parquet, tombstones of deleted documents, and a row of manifests for each index.

Each file of a segment's postings is sorted by token, so that a search prunes row groups by its tokens. A new segment has a file for
each task that tokenized rows, and its postings are not shuffled; a merged one is range-partitioned, so that files are pruned too. A
segment becomes visible with the manifest that names it. Manifests are numbered and never replaced: each change writes the next
number by a rename that fails if that number is taken, and is then made anew on what the other writer left. An append whose key is
in the manifest already has been made, so that a streaming batch that is run again adds nothing.

Each segment has its distinct tokens beside its postings, for fuzzy searches. Segments have levels: FAN of one level are merged into
one of the next when an append makes them so many, so that a stream leaves few and each posting is rewritten once a level.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import FULL_TEXT, Analyzer
from ..operators.index import TokenIndex, key_column, postings_of, postings_schema


#: Segments of a level that are merged into one of the next.
FAN = 16


def _level(segment: str) -> int:
    m = re.match(r"segment-level(\d+)-", segment)
    return int(m[1]) if m else 0


class ReadOnly(RuntimeError):
    pass


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        at = self._p(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def _read(self, name: str) -> dict:
        versions = self._versions(name)
        if not versions:
            raise KeyError(f"no index {name!r}")
        stream = self._fs.open(self._p(f"{self.path}/{name}/manifest-{versions[-1]}.json"))
        try:
            found = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        return found | {"version": versions[-1]}

    def _write(self, name: str, manifest: dict) -> bool:
        """Whether the manifest became the next one; not so if another writer was first."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        version = manifest.get("version", 0) + 1
        draft, final = self._p(f"{self.path}/{name}/.manifest-{uuid.uuid4().hex}"), self._p(f"{self.path}/{name}/manifest-{version}.json")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest | {"version": version, "changed": time.time()}).encode()))
        stream.close()
        if version <= max(self._versions(name), default=0):
            self._fs.delete(draft, False)
            return False
        rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            rename.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _change(self, name: str, change: Callable[[dict], dict | None]) -> None:
        """Apply a change to the newest manifest, again if another writer came first; None leaves all as it is."""
        for _ in range(100):
            new = change(self._read(name))
            if new is None or self._write(name, new):
                return
        raise RuntimeError(f"index {name!r} changes too often")

    def _check(self) -> None:
        if not self.is_writable():
            raise ReadOnly("the store is not writable")

    def _segment(self, name: str, key: str, postings: DataFrame, documents: DataFrame, id_type: str | None = None, merged: bool = False) -> None:
        if id_type:
            postings, documents = (d.withColumn("doc_id", F.col("doc_id").cast(id_type)) for d in (postings, documents))
        if merged:  # so many partitions as there are, fewer where adaptive execution finds them small; bounds take a pass over the postings
            postings = postings.repartitionByRange("token", "doc_id")
        postings.sortWithinPartitions("token", "doc_id", "section", "position").write.mode("overwrite").parquet(f"{self.path}/{name}/{key}/postings")
        documents.write.mode("overwrite").parquet(f"{self.path}/{name}/{key}/documents")
        written = self.spark.read.schema("token string").parquet(f"{self.path}/{name}/{key}/postings")
        written.distinct().write.mode("overwrite").parquet(f"{self.path}/{name}/{key}/words")

    def create(self, name: str, df: DataFrame | None, id_col: str | list[str], columns: list[str], analyzer: Analyzer = FULL_TEXT, table: str | None = None, id_type: str = "bigint") -> TokenIndex:
        """Build an index; without df an empty one. id_type is needed there alone, and for keys that are not long."""
        self._check()
        if self._versions(name):
            raise FileExistsError(f"index {name!r} is there already")
        id_type = df.select(key_column(id_col).alias("k")).schema["k"].dataType.simpleString() if df is not None else id_type
        manifest = {"name": name, "id": id_col, "id_type": id_type, "columns": list(columns), "analyzer": asdict(analyzer), "table": table or name, "segments": [], "deleted": [], "sections": len(columns)}
        if df is not None:
            self._segment(name, first := f"segment-{uuid.uuid4().hex}", postings_of(df, id_col, list(columns), analyzer), df.select(key_column(id_col).alias("doc_id")))
            manifest["segments"].append(first)
        if not self._write(name, manifest):
            raise FileExistsError(f"index {name!r} is there already")
        return self.open(name)

    def _analyzer(self, manifest: dict) -> Analyzer:
        a = dict(manifest["analyzer"])
        a["token_filters"], a["substitutions"] = tuple(a["token_filters"]), tuple(map(tuple, a["substitutions"]))
        return Analyzer(**a)

    def append(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Index more rows as a segment of their own; an append with a key that was made before does nothing."""
        self._check()
        m = self._read(name)
        key = f"segment-{key or uuid.uuid4().hex}"
        if key in m["segments"] or key in m.get("merged", []):
            return
        self._segment(name, key, postings_of(df, m["id"], m["columns"], self._analyzer(m)), df.select(key_column(m["id"]).alias("doc_id")), m["id_type"])
        self._change(name, lambda m: None if key in m["segments"] or key in m.get("merged", []) else m | {"segments": [*m["segments"], key]})
        self.compact(name)

    def compact(self, name: str) -> int:
        """Merge FAN segments of a level, the lowest first, into one of the next until no level has so many; how many merges were made.

        What deletions took from them is left out. Keys of merged appends stay known, so that these are not made again.
        """
        self._check()
        made = 0
        while True:
            m = self._read(name)
            levels: dict[int, list[str]] = {}
            for k in m["segments"]:
                levels.setdefault(_level(k), []).append(k)
            full = [level for level in sorted(levels) if len(levels[level]) >= FAN]
            if not full:
                return made
            some = levels[full[0]][:FAN]
            live, key = self._open(name, m | {"segments": some}), f"segment-level{full[0] + 1}-{uuid.uuid4().hex}"
            self._segment(name, key, live.postings, live.documents, merged=True)
            seen = {k for k, of in m["deleted"]}

            def change(now: dict) -> dict | None:
                if not set(some) <= set(now["segments"]):
                    return None  # another compaction was first
                # deletions that came meanwhile hold for the merged segment too
                deleted = [[k, [x for x in of if x not in some] + [key] * (k not in seen and any(x in some for x in of))] for k, of in now["deleted"]]
                return now | {"segments": [key, *(k for k in now["segments"] if k not in some)], "deleted": [d for d in deleted if d[1]], "merged": [*now.get("merged", []), *some]}

            self._change(name, change)
            made += 1

    def delete(self, name: str, ids: DataFrame) -> None:
        """Documents (by the key columns in ids) that no search finds from now on, in the segments there are now."""
        self._check()
        m = self._read(name)
        key = f"deleted-{uuid.uuid4().hex}"
        ids.select((F.col(ids.columns[0]) if isinstance(m["id"], str) else F.struct(*ids.columns)).cast(m["id_type"]).alias("doc_id")).distinct().write.parquet(f"{self.path}/{name}/{key}")
        self._change(name, lambda m: m | {"deleted": [*m["deleted"], [key, list(m["segments"])]]})

    def open(self, name: str) -> TokenIndex:
        return self._open(name, self._read(name))

    def _open(self, name: str, m: dict) -> TokenIndex:
        analyzer, spark = self._analyzer(m), self.spark
        rows, ids = postings_schema(m["id_type"]), f"doc_id {m['id_type']}"
        postings, documents = spark.createDataFrame([], rows), spark.createDataFrame([], ids)
        groups: dict[tuple, list[str]] = {}
        for s in m["segments"]:
            groups.setdefault(tuple(k for k, of in m["deleted"] if s in of), []).append(s)
        first = True
        for gone, segments in groups.items():
            p = spark.read.schema(rows).parquet(*[f"{self.path}/{name}/{s}/postings" for s in segments])
            d = spark.read.schema(ids).parquet(*[f"{self.path}/{name}/{s}/documents" for s in segments])
            if gone:
                dead = spark.read.schema(ids).parquet(*[f"{self.path}/{name}/{k}" for k in gone])
                p, d = p.join(dead, "doc_id", "left_anti").select(*postings.columns), d.join(dead, "doc_id", "left_anti")
            postings, documents = (p, d) if first else (postings.unionByName(p), documents.unionByName(d))
            first = False
        words = [f"{self.path}/{name}/{s}/words" for s in m["segments"]]
        words = spark.read.schema("token string").parquet(*words) if words and all(self._fs.exists(self._p(w)) for w in words) else None
        return TokenIndex(postings, documents, analyzer, m["sections"], tuple(m["columns"]), words)

    def vacuum(self, name: str, grace: float = 3600.0) -> None:
        """One segment of what is alive, in place of the segments and tombstones there are now; their files go.

        Files that no manifest names, left by writers that failed, go when they are older than `grace` seconds.
        """
        self._check()
        old, live = self._read(name), self.open(name)
        key = f"segment-{uuid.uuid4().hex}"
        self._segment(name, key, live.postings, live.documents, merged=True)
        gone = {*old["segments"], *(k for k, _ in old["deleted"])}

        def change(m: dict) -> dict | None:
            if not set(old["segments"]) <= set(m["segments"]):
                return None  # another compaction was first
            later = [[k, [key if s in gone else s for s in of]] for k, of in m["deleted"] if k not in gone]
            return m | {"segments": [key, *(s for s in m["segments"] if s not in gone)], "deleted": [[k, list(dict.fromkeys(of))] for k, of in later], "merged": [*m.get("merged", []), *old["segments"]]}

        self._change(name, change)
        now = self._read(name)
        named = {*now["segments"], *(k for k, _ in now["deleted"])}
        for status in self._fs.listStatus(self._p(f"{self.path}/{name}")):
            n = status.getPath().getName()
            late = status.getModificationTime() / 1000 < time.time() - grace
            stale = n.startswith("manifest-") and n != f"manifest-{now['version']}.json"
            if stale or n not in named and (n in gone or late and not n.startswith("manifest-")):
                self._fs.delete(status.getPath(), True)

    def truncate(self, name: str) -> int:
        """Drop manifests before the newest; how many went. Readers that have opened an older one keep their files until vacuum()."""
        self._check()
        old = self._versions(name)[:-1]
        for v in old:
            self._fs.delete(self._p(f"{self.path}/{name}/manifest-{v}.json"), False)
        return len(old)

    def names(self) -> list[str]:
        if not self._fs.exists(self._p(self.path)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(self.path)) if self._versions(s.getPath().getName()))

    def table_name(self, name: str) -> str:
        return self._read(name)["table"]

    def column_name(self, name: str, column: str | int) -> str | None:
        columns = self._read(name)["columns"]
        if isinstance(column, int):
            return columns[column] if 0 <= column < len(columns) else None
        return column if column in columns else None

    def status(self) -> DataFrame:
        """(name, version, segments, deletions, changed) of every index."""
        rows = [(n, m["version"], len(m["segments"]), len(m["deleted"]), m["changed"]) for n in self.names() for m in [self._read(n)]]
        return self.spark.createDataFrame(rows, "name string, version long, segments int, deletions int, changed double")

    def broken(self) -> list[str]:
        """Indexes whose manifest names files that are not there."""
        out = []
        for n in self.names():
            m = self._read(n)
            if not all(self._fs.exists(self._p(f"{self.path}/{n}/{k}")) for k in (*m["segments"], *(k for k, _ in m["deleted"]))):
                out.append(n)
        return out

    def lagged(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows of a table that the index does not have yet."""
        m = self._read(name)
        have = self.open(name).documents.select(F.col("doc_id").alias("__have"))
        return rows.withColumn("__key", key_column(m["id"]).cast(m["id_type"])).join(have, F.col("__key") == F.col("__have"), "left_anti").drop("__key")

    def flush(self, name: str) -> bool:
        """True: what is written is committed already."""
        self._read(name)
        return True

    def drop(self, name: str) -> None:
        self._check()
        self._fs.delete(self._p(f"{self.path}/{name}"), True)

    def set_writable(self, writable: bool) -> bool:
        """Whether any session may change the store; kept in the store."""
        mark = self._p(f"{self.path}/read-only")
        if writable:
            self._fs.delete(mark, False)
        else:
            self._fs.create(mark, True).close()
        return writable

    def is_writable(self) -> bool:
        return not self._fs.exists(self._p(f"{self.path}/read-only"))

    def applied_position(self, name: str) -> int:
        """How far a source is applied to an index: what set_applied_position() said, or the number of its manifest."""
        m = self._read(name)
        return m.get("applied", m["version"])

    def set_applied_position(self, name: str | None = None, position: int | None = None) -> bool:
        """Take an index (or each) as applied up to a position of its source; without one, up to its newest manifest."""
        self._check()
        for n in self.names() if name is None else [name]:
            self._change(n, lambda m: m | {"applied": m["version"] + 1 if position is None else position})
        return True
