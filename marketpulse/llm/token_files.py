"""Flat token files with 64-bit document offsets."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import partitions, text_of
from marketpulse.llm.tokens import encoder

PART = "part int, file string, n_docs long, n_tokens long, n_null_ids long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text and write the ids in ascending doc_id order below ``path``.

    ``path`` holds for each part of the sorted documents ``<file>.ids`` (flat unsigned integers,
    16 bits wide if all ids fit, else 32), ``<file>.offsets`` (64-bit, n_docs + 1 places counted in ids from the
    part's start) and ``<file>.docs`` (64-bit doc_ids), and a Parquet table ``manifest`` with a row per part and
    its bases: the documents and ids of all parts before it, from prefix sums over the parts.

    Texts are dealt into ranges of doc_id once and encoded in the task that writes them. File names
    are unique for each attempt and only those of the attempt that Spark accepts are in the
    manifest, so lost or repeated tasks leave whole files. Memory is bounded by an Arrow batch.

    NULL texts are empty: their ids are the end id alone. NULL doc_ids come first and are counted
    in the manifest. Repeated doc_ids follow by hash and text. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    data = f"{path}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        width = "<u2" if max(tool.top, end_id) < 1 << 16 else "<u4"
        store, root = fs.FileSystem.from_uri(data)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        outs, n_docs, n_tokens, nulls = None, 0, 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if outs is None and batch.num_rows:
                outs = {k: store.open_output_stream(f"{root}/{name}.{k}") for k in ("ids", "offsets", "docs")}
                outs["offsets"].write(np.zeros(1, "<i8").tobytes())
            doc_ids = batch.column(0)
            for start, found in tool.steps(batch.column(1).to_pylist()):
                ids = np.frombuffer(b"".join(x + end for x in found), "<u4")
                outs["ids"].write(ids.astype(width).tobytes())
                ends = n_tokens + np.cumsum([len(x) // 4 + 1 for x in found], dtype=np.int64)
                outs["offsets"].write(ends.astype("<i8").tobytes())
                n_tokens = int(ends[-1])
                own = doc_ids.slice(start, len(found))
                outs["docs"].write(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nulls += own.null_count
            n_docs += batch.num_rows
        if outs:
            for o in outs.values():
                o.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_null_ids": [nulls]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    parts = f"{path}/parts"
    dealt.mapInArrow(write, PART).write.parquet(parts)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part.
    spark.read.schema(PART).parquet(parts).select(
        "*", F.coalesce(F.sum("n_docs").over(earlier), F.lit(0)).alias("doc_base"),
        F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("token_base")).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of token files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if wanted, ``ids``.

    A part's files are memory-mapped where the store is a file system, else opened by range, and
    read document by document.
    """
    data = f"{path}/data"
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def open_flat(store, file: str, kind: str):
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(file, kind, "r")
        return np.frombuffer(store.open_input_file(file).read_buffer(), kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(data)
        for batch in batches:
            for row in batch.to_pylist():
                offsets = open_flat(store, f"{root}/{row['file']}.offsets", "<i8")
                size = store.get_file_info(f"{root}/{row['file']}.ids").size // row["n_tokens"]
                ids = open_flat(store, f"{root}/{row['file']}.ids", f"<u{size}")
                docs = open_flat(store, f"{root}/{row['file']}.docs", "<i8")
                for a in range(0, row["n_docs"], 1024):
                    places = offsets[a : a + 1025].tolist()
                    runs = [ids[x:y].astype("<u4") for x, y in zip(places, places[1:])]
                    out = {
                        "doc_id": pa.array(docs[a : a + len(runs)], pa.int64(), mask=np.arange(a, a + len(runs)) < row["n_null_ids"]),
                        "start": pa.array([row["token_base"] + x for x in places[:-1]], pa.int64()),
                        "n_tokens": pa.array([len(r) for r in runs], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(r.tobytes()) for r in runs], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([r.tolist() for r in runs], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    manifest = spark.read.schema(f"{PART}, doc_base long, token_base long").parquet(f"{path}/manifest")
    return manifest.repartition(partitions(spark), "part").mapInArrow(read, schema).select(*names)
