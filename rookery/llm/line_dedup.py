"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines of a document chooses where a chunk of lines ends, so inserted or missing lines move no
boundary but the nearest. A boundary right after another one does not count, so a chunk has two lines at least (but for documents of
one line). Chunks of several lines that occur more than once in the corpus stay where they come first, by document id and
place, and go everywhere else, once their bytes prove equal: grouping the hashed-alike chunks by their very text is the comparison, and it
collapses copies before the shuffle. What is joined with the documents grows with them, so it is never broadcast, however small it starts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import col, cut, fresh, narrow

#: Lines that the rolling hash sees; a boundary every so many lines on average; most lines of a chunk (one more, if it would stand alone).
WINDOW, EVERY, MOST = 2, 3, 64


def chunk_lines(lines: list[str], window: int = WINDOW, every: int = EVERY, most: int = MOST) -> list[tuple[int, int]]:
    """(first line, end) of each chunk, in order; they cover all lines."""
    if not lines:
        return []
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s.encode()) for s in lines), np.uint64, len(lines))
    rolled = hashes.copy()
    for back in range(1, window):
        rolled[back:] += hashes[:-back] * np.uint64((0x9E3779B97F4A7C15 * (2 * back + 1)) % (1 << 64)) if len(hashes) > back else np.uint64(0)
    rolled ^= rolled >> np.uint64(29)
    ends: list[int] = []
    for end in (np.flatnonzero(rolled % np.uint64(max(1, every - 1)) == 0) + 1).tolist():  # two lines, then one in every - 1: `every` on average
        if end - (ends[-1] if ends else 0) > 1 and len(lines) - end > 1:
            ends.append(end)
    out, start = [], 0
    for end in [*ends, len(lines)]:
        while end > start:
            stop = end if end - start <= most + 1 else start + most  # no single line is left over
            out.append((start, stop))
            start = stop
    return out


def _halves(text: str) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(text.encode())
    return [int.from_bytes(x, "big", signed=True) for x in (n.to_bytes(16, "big")[:8], n.to_bytes(16, "big")[8:])]


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, first, until (line numbers) and a 128-bit hash of each chunk of two or more lines with a word in one of them."""

    def chunked(batches):
        for batch in batches:
            out = []
            for doc_id, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                lines = text.split("\n") if text else []
                for a, b in chunk_lines(lines):
                    if b - a > 1 and (whole := "\n".join(lines[a:b])).strip():
                        out.append((doc_id, text_hash, a, b, *_halves(whole)))
            columns = [*zip(*out, strict=True)] or [()] * 6
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "text_hash", "first", "until", "h1", "h2"])

    rows = narrow(docs, doc_id=id_col, text=text_col).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(chunked, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, first int, until int, h1 long, h2 long")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, first, until, kept_doc_id, kept_first: the chunks to remove and where each one's equal stays."""
    chunks = cut(line_chunks(docs, id_col, text_col), "chunks")
    groups = chunks.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "first", "text_hash")).alias("kept")).where("n > 1").select("h1", "h2", "kept")
    groups = cut(groups, "groups")  # so that the join's large partitions can be split
    marks = cut(chunks.join(groups, ["h1", "h2"]), "marks")

    # Byte comparison: the chunks' texts, grouped by hash and text. A text of its own in a group keeps its own first place.
    @F.pandas_udf("array<string>")
    def cut_out(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, places, strict=True):
            lines = text.split("\n")
            out.append(["\n".join(lines[s["first"] : s["until"]]) for s in spans])
        return pd.Series(out, dtype=object)

    listed = marks.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "until", "h1", "h2", "kept")).alias("spans"))
    rows = narrow(docs, id=id_col, text=text_col)
    texts = rows.join(listed.hint("merge"), (rows["id"] == listed["doc_id"]) & (F.xxhash64(rows["text"]) == listed["text_hash"])).select("doc_id", "text_hash", "spans", cut_out("text", "spans").alias("texts"))
    each = texts.select("doc_id", "text_hash", F.explode(F.arrays_zip("spans", "texts")).alias("x")).select("doc_id", "text_hash", "x.spans.*", F.col("x.texts").alias("text"))
    own = each.groupBy("h1", "h2", "text").agg(F.min(F.struct("doc_id", "first", "text_hash")).alias("own"), F.min("kept").alias("kept"))
    false = own.where("own <> kept").select("own.doc_id", "own.first", "own.text_hash")
    removed = marks.where("struct(doc_id, first, text_hash) <> kept").select("doc_id", "text_hash", "first", "until", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.first").alias("kept_first"))
    return removed.join(cut(false, "unequal"), ["doc_id", "text_hash", "first"], "left_anti")


def remove_chunks(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs without the removed chunks' lines; all rows and other columns stay (a text that loses all its lines is empty).

    count_col: name of a further column, the number of lines removed.
    """

    @F.pandas_udf("string")
    def without(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, places, strict=True):
            if text is None or spans is None:
                out.append(text)
                continue
            lines = text.split("\n")
            gone = {i for s in spans for i in range(s["first"], s["until"])}
            out.append("\n".join([x for i, x in enumerate(lines) if i not in gone]))
        return pd.Series(out, dtype=object)

    whose, held, places = (fresh(docs, n) for n in ("whose", "held", "places"))
    spans = removed.groupBy(F.col("doc_id").alias(whose), F.col("text_hash").alias(held)).agg(F.collect_list(F.struct("first", "until")).alias(places))
    both = docs.join(spans.hint("merge"), (col(docs, id_col) == spans[whose]) & (F.xxhash64(col(docs, text_col)) == spans[held]), "left")
    text = F.coalesce(without(F.when(F.col(places).isNotNull(), col(docs, text_col)), F.col(places)), col(docs, text_col))
    count = [F.coalesce(F.aggregate(F.col(places), F.lit(0), lambda s, x: s + x["until"] - x["first"]), F.lit(0)).cast("long").alias(count_col)] if count_col else []
    return both.select(*((text if c == text_col else col(docs, c)).alias(c) for c in docs.columns), *count)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the repeated multi-line chunks removed but for their first occurrence; see remove_chunks.

    Null texts stay null. Rows with a null id stay as they are and count for nothing. Rows that share an id and a text are one document
    here: neither loses lines to the other. Columns of docs may have any names. An empty table gives an empty one.
    """
    return remove_chunks(docs, repeated_chunks(docs, id_col, text_col), id_col, text_col, count_col)
