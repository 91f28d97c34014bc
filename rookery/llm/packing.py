"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Every task best-fits the pieces of its own documents, emits the (nearly) full sequences and passes the others on as items whose
length is their fill. Those are merged, several tasks into one, and best-fitted again, round by round, until as many tasks are
left as the items need for good fits; the last round emits all. No task ever holds more than a bounded number of items.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.chunks import library_ids
from rookery.llm.common import cut, narrow

#: Items that a task best-fits at once; tasks merged into one a round; tokens that a sequence may lack and be emitted before the last round.
ITEMS, FAN_IN, SLACK = 100_000, 8, 0


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin, offset) of each item and the fill of each bin. Ties: earlier item first, latest opened bin."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        fills[b] += n
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, fills


def _cut_text(ids: bytes, capacity: int):
    """(piece, start, length, crc) of a document: the first piece takes what the full ones leave."""
    total = len(ids) // 4
    start, piece, length = 0, 0, total % capacity or capacity
    while start < total:
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, piece, length = start + length, piece + 1, capacity


FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]


def best_fit_packing(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each text's ids with end_id after them; only longer ones than `capacity` are cut, into pieces of that length of which the first may
    be shorter. A null or empty text is the end id alone. Repeated rows are packed as often as they are there (then doc_id and piece
    name several rows). An empty table gives none. Other columns are not read. Sequences are numbered with gaps.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"

    def first(batches):
        from pyspark import TaskContext

        library = library_ids(tokenizer_path, pattern)
        made, base = 0, TaskContext.get().partitionId() << 32
        held: list = []
        keys: list = []
        count = 0

        def packed_rows():
            nonlocal made
            table = np.array(held, dtype=np.int64).reshape(-1, 4)
            bins, offsets, fills = best_fit(table[:, 2], capacity)
            number, fill = base + made + np.array(bins, dtype=np.int64), np.array(fills, dtype=np.int64)[bins]
            made += len(fills)
            ids = pa.array([keys[k] for k in owner], rows_type)
            return pa.RecordBatch.from_arrays([ids, pa.array(table[:, 0], pa.int32()), *(pa.array(table[:, i]) for i in (1, 2, 3)), pa.array(number), pa.array(offsets, pa.int64()), pa.array(fill)], FIELDS)

        owner: list = []
        rows_type = None
        for batch in batches:
            rows_type = batch.schema.field("doc_id").type
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b, offsets, ids in library.blocks(batch.column("text"), end_id):
                whole, offsets = ids.tobytes(), (4 * offsets).tolist()
                for doc_id, start, end in zip(doc_ids[a:b], offsets, offsets[1:], strict=False):
                    pieces = [*_cut_text(whole[start:end], capacity)]
                    owner += [len(keys)] * len(pieces)
                    keys.append(doc_id)
                    held += pieces
                if len(held) >= items:
                    yield packed_rows()
                    held, keys, owner = [], [], []
        if held:
            yield packed_rows()

    def merge(turn: int):
        def merged(batches):
            from pyspark import TaskContext

            found = [b for b in batches if b.num_rows]
            if not found:
                return
            table = pa.Table.from_batches(found).combine_chunks()
            number, fill = table.column("bin").to_numpy(), table.column("fill").to_numpy()
            ids, at, of = np.unique(number, return_index=True, return_inverse=True)
            bins, shifts, fills = best_fit(fill[at], capacity)
            bins = np.array(bins, dtype=np.int64)
            number = (turn << 56) + (TaskContext.get().partitionId() << 32) + bins
            new = [pa.array(number[of]), pa.array(table.column("offset").to_numpy() + np.array(shifts, dtype=np.int64)[of]), pa.array(np.array(fills, dtype=np.int64)[bins][of])]
            yield from pa.Table.from_arrays([*(table.column(f) for f in FIELDS[:5]), *new], FIELDS).to_batches(max_chunksize=50_000)

        return merged

    packs = cut(rows.mapInArrow(first, schema), "packed")
    parts, turn, out = rows.rdd.getNumPartitions(), 0, []
    while True:
        left = packs.where(F.col("fill") < capacity - SLACK)
        open_bins = left.where("offset = 0").count()
        least = max(1, -(-open_bins // items))
        if open_bins < 2 or turn and parts <= least:
            break
        out.append(packs.where(F.col("fill") >= capacity - SLACK))
        parts, turn = max(least, -(-parts // fan_in)), turn + 1
        packs = cut(left.repartition(parts, F.xxhash64("bin", F.lit(turn))).mapInArrow(merge(turn), schema), "packed")
    out.append(packs)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
