"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are range-partitioned by id before they are encoded, so each file holds a range of ids in ascending order; readers take
stripes in parallel and skip files, stripes and row groups by their statistics and Bloom filters. part and row say where in the
order a document stands: both compress to nothing, and no reader needs file names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rookery.llm.chunks import library_ids
from rookery.llm.common import cut, narrow

OPTIONS = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> T.StructType:
    """Write part, row, doc_id and ids for every row of docs, in ascending order of doc_id over files and rows; returns the schema.

    Null ids come first; rows that share an id stand in the order of a hash of their text, which also splits an id of very many rows over
    files. A null or empty text has the end id alone. An empty table writes no rows. Other columns are not read.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encoded(batches):
        from pyspark import TaskContext

        library = library_ids(tokenizer_path, pattern)
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, offsets, ids in library.blocks(batch.column("text"), end_id):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), pa.array(np.arange(row, row + b - a)), batch.column("doc_id").slice(a, b - a), lists], ["part", "row", "doc_id", "ids"])
                row += b - a

    ranged.mapInArrow(encoded, schema).write.format("orc").options(**OPTIONS).save(path)
    return schema


def read_token_ids(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the files; conditions on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema(schema).orc(path)


def token_id_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of the files; start counts all ids before the row."""

    def digested(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "row", "doc_id")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    rows = files.select("part", "row", "doc_id", "ids").mapInArrow(digested, f"part int, row long, doc_id {files.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long")
    rows = cut(rows, "digests")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = Window.partitionBy("part").orderBy("row")
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
