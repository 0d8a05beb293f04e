"""The engine's tables: schemas and a versioned Parquet layout per workspace.

Rows of a table lie in buckets by the hash of its key.  A version is a manifest
that names the folders of every bucket; an append adds folders, a replacement
writes only the buckets it touches, and all other files stay as they are.
Commits are numbered, and a number is taken by creating its file exclusively, so
of two writers one is first and the other starts again from the new version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "full_docs": "id string, content string",
    "doc_status": "id string, content_summary string, content_length int, file_path string, status string, created_at timestamp, updated_at timestamp, track_id string, chunks_count int, error_msg string, time_label string",
    "text_chunks": "id string, content string, tokens int, chunk_order_index int, full_doc_id string, file_path string, time_label string",
    "entity_mentions": "entity_name string, entity_type string, description string, source_id string, file_path string, full_doc_id string, ord string",
    "relation_mentions": "src_id string, tgt_id string, weight double, keywords string, description string, source_id string, file_path string, full_doc_id string, ord string",
    "nodes": "entity_name string, entity_type string, source_id string, mentions bigint, description string, file_path string",
    "edges": "src string, tgt string, weight double, source_id string, mentions bigint, keywords string, description string",
    "vdb_entities": "id string, entity_name string, content string, vector array<float>",
    "vdb_relationships": "id string, src string, tgt string, content string, vector array<float>",
    "vdb_chunks": "id string, full_doc_id string, vector array<float>",
    "llm_response_cache": "digest string, answer string, context string",
    "merge_log": "a string, b string, hash_a string, hash_b string, decision string, decided_at timestamp",
}
#: What a table's buckets follow.
KEYS = {
    "full_docs": ["id"], "doc_status": ["id"], "text_chunks": ["id"], "entity_mentions": ["source_id"], "relation_mentions": ["source_id"], "nodes": ["entity_name"], "edges": ["src", "tgt"],
    "vdb_entities": ["id"], "vdb_relationships": ["id"], "vdb_chunks": ["id"], "llm_response_cache": ["digest"], "merge_log": ["a", "b"],
}
BUCKETS = 16
#: Versions kept for readers that opened them; older files are removed after a commit.
KEEP = 4
#: Folders of a bucket from which an append rewrites the bucket as one.
MOST_FOLDERS = 24
_BUCKET = "_bucket"


class Store:
    """Tables of one workspace.  ``buckets`` is fixed when a table is first written."""

    def __init__(self, spark: SparkSession, root: str, workspace: str = "default", buckets: int = BUCKETS):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{workspace}"
        self.buckets = buckets

    # -- files --

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str, exclusive: bool) -> bool:
        """Write a small file; false when it is there already."""
        p, fs = self._fs(path)
        if exclusive and fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception as e:  # the JVM's FileAlreadyExistsException, of whatever file system
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _slurp(self, path: str) -> str:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _commits(self, name: str) -> list[int]:
        p, fs = self._fs(f"{self.root}/{name}/commits")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())

    def _manifest(self, name: str) -> tuple[int, dict]:
        """The last number taken and the content of the current version.

        A commit whose file is empty is being written, or its writer died: after
        a second it is passed over.
        """
        numbers = self._commits(name)
        for n in reversed(numbers):
            for _ in range(20):
                version = self._slurp(f"{self.root}/{name}/commits/{n:010d}")
                if version:
                    return numbers[-1], json.loads(self._slurp(f"{self.root}/{name}/manifests/{version}"))
                time.sleep(0.05)
        return max(numbers, default=0), {"buckets": self.buckets, "folders": {}}

    def _commit(self, name: str, n: int, manifest: dict) -> bool:
        version = uuid.uuid4().hex
        self._put(f"{self.root}/{name}/manifests/{version}", json.dumps(manifest), False)
        if not self._put(f"{self.root}/{name}/commits/{n:010d}", version, True):
            return False
        self._remove_old(name, manifest)
        return True

    def _remove_old(self, name: str, current: dict) -> None:
        """Remove versions beyond ``KEEP``, and the folders that no kept version names."""
        numbers = self._commits(name)
        old, kept = numbers[:-KEEP], numbers[-KEEP:]
        if not old:
            return
        folders = lambda m: {f for fs in m["folders"].values() for f in fs}
        version_of = {k: self._slurp(f"{self.root}/{name}/commits/{k:010d}") for k in numbers}
        read = lambda k: json.loads(self._slurp(f"{self.root}/{name}/manifests/{version_of[k]}")) if version_of[k] else {"folders": {}}
        held = set.union(folders(current), *(folders(read(k)) for k in kept))
        for k in old:
            version = version_of[k] or "none"
            gone = folders(read(k)) - held
            for f in [*gone, f"manifests/{version}", f"commits/{k:010d}"]:
                p, fs = self._fs(f"{self.root}/{name}/{f}")
                fs.delete(p, True)

    # -- reading --

    def columns(self, name: str) -> list[str]:
        return [c.split()[0] for c in SCHEMAS[name].split(", ")]

    def _read(self, name: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.root}/{name}/{f}" for b, fs in manifest["folders"].items() for f in fs if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders)

    def read(self, name: str) -> DataFrame:
        return self._read(name, self._manifest(name)[1])

    def _bucket(self, name: str, buckets: int):
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")

    # -- writing --

    def _write(self, name: str, df: DataFrame, buckets: int) -> dict[str, list[str]]:
        """New folders by bucket.  Adaptive execution splits a bucket that is too large for one file."""
        folder = f"data/{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{folder}"
        df.select(*self.columns(name)).withColumn(_BUCKET, self._bucket(name, buckets)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(path)
        p, fs = self._fs(path)
        made = [s.getPath().getName() for s in fs.listStatus(p)]
        return {m.split("=")[1]: [f"{folder}/{m}"] for m in made if m.startswith(f"{_BUCKET}=")}

    def _change(self, name: str, change: Callable[[dict], dict]) -> DataFrame:
        """Commit ``change`` of the current manifest; again from the start when another writer was first."""
        while True:
            n, manifest = self._manifest(name)
            if self._commit(name, n + 1, change(manifest)):
                return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows; no written file is touched, but a bucket of many folders is written as one."""
        made: dict = {}

        def change(manifest: dict) -> dict:
            if not made:  # what is written serves a second try too
                made.update(self._write(name, df, manifest["buckets"]))
            folders = {b: [*manifest["folders"].get(b, []), *made.get(b, [])] for b in {*manifest["folders"], *made}}
            many = [int(b) for b, fs in folders.items() if len(fs) > MOST_FOLDERS]
            if many:
                whole = self._write(name, self._read(name, {"folders": folders}, many), manifest["buckets"])
                folders |= {str(b): whole.get(str(b), []) for b in many}
            return manifest | {"folders": folders}

        return self._change(name, change)

    def replace(self, name: str, gone: DataFrame, on: list[str], rows: DataFrame | None = None) -> DataFrame:
        """Remove the rows that agree with ``gone`` in ``on`` and add ``rows``; only touched buckets are written.

        ``gone`` and ``rows`` must not change while this runs: pass written tables.
        """

        def change(manifest: dict) -> dict:
            if not manifest["folders"]:
                return manifest if rows is None else manifest | {"folders": self._write(name, rows, manifest["buckets"])}
            old = self._read(name, manifest)
            keys = gone.select(*on).distinct()
            hit = keys if set(on) == set(KEYS[name]) else old.join(keys, on, "left_semi")
            touched = hit.select(self._bucket(name, manifest["buckets"]).alias("b"))
            if rows is not None:
                touched = touched.union(rows.select(self._bucket(name, manifest["buckets"]).alias("b")))
            numbers = [r["b"] for r in touched.distinct().collect()]  # at most as many as buckets
            if not numbers:
                return manifest
            kept = self._read(name, manifest, numbers).join(keys, on, "left_anti").select(*self.columns(name))
            made = self._write(name, kept if rows is None else kept.unionByName(rows.select(*self.columns(name))), manifest["buckets"])
            return manifest | {"folders": {b: fs for b, fs in manifest["folders"].items() if int(b) not in numbers} | made}

        return self._change(name, change)

    def upsert(self, name: str, rows: DataFrame, key: list[str] | None = None) -> DataFrame:
        """Rows by their key: new ones are added, known ones replaced."""
        return self.replace(name, rows, key or KEYS[name], rows)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """The whole table anew."""
        return self._change(name, lambda manifest: manifest | {"folders": self._write(name, df, manifest["buckets"])})

    def drop(self, name: str) -> None:
        """Truncate a table."""
        self._change(name, lambda manifest: manifest | {"folders": {}})
