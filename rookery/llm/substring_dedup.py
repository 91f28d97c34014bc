"""Substring dedup by paragraph MinHash banding.

A paragraph is a line of at least `least` words, or a run of shorter lines (wrapped text; it ends at a longer or a blank line) that has so
many words in all. It has `bands` keys of `rows` MinHash values of five-word shingles each. Paragraphs that share a key are joined and
verified by exact Jaccard similarity; what is linked forms components, and in each all but the first occurrence (by document id and
place) are removals. With 5 bands of 2 a pair at similarity 0.8 shares a key with probability 0.994, at 0.9 with 0.9998.

Added to the method, since passages also stand inside longer lines, where no paragraph begins or ends: blocks, which the words themselves
delimit (a boundary wherever the hash of three words is least within `window` places), so that a passage holds the same blocks wherever it
stands. A block has one key, a hash of its words, and is verified by a further hash of 128 bits; all but the first occurrence are removals, where adjacent
ones have `passage` words or more. Their spans say "block".

Within a key each paragraph is compared with two pivots, the least and the greatest; what that joins is one component. Lines of one key that
are still in different components are then compared pair by pair, where the key has at most CROWD members. Members of larger ones
(families of lines that resemble each other less than the threshold) are first compared with PIVOTS more of each key; those then still
apart are joined exactly, on the rarest of their shingles: each pair of them that is similar enough is found, and pairs that are proven
too unlike by sizes and places of shared shingles are never compared.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import cut, drop, narrow
from rookery.llm.components import connected_components
from rookery.llm.similar import ODD, SHINGLE, SIMILARITY, links_apart, mixed, shingle_hashes, verified, word_hashes

LEAST, WINDOW, PASSAGE, BANDS, ROWS = 20, 20, 16, 5, 2
#: Members of a key of lines that are compared pair by pair; pivots of larger keys.
CROWD, PIVOTS = 24, 4
WORD = re.compile(r"\S+")
_ADD = np.random.default_rng(11).integers(1, 1 << 63, 128, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_TOP = np.uint32((1 << 32) - 1)
#: MinHash orders, on the upper halves of shingle hashes: an odd factor and a term each.
_ODD32, _ADD32 = (ODD[16:80] >> np.uint64(16)).astype(np.uint32) | np.uint32(1), (_ADD[:64] >> np.uint64(16)).astype(np.uint32)


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    if len(kept.get(base, ())) < n:
        out = np.full(max(n, 1 << 14), base, np.uint64)
        out[0] = 1
        kept[base] = np.multiply.accumulate(out)
    return kept[base][:n]


def _least_places(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some `window` neighbours: those where the greatest least of the windows they stand in is theirs."""

    def sliding(x: np.ndarray, of) -> np.ndarray:
        wide, left = 1, window
        while 2 * wide <= left:
            x, wide = of(x[:-wide], x[wide:]), 2 * wide
        return of(x[: len(x) - (left - wide)], x[left - wide :]) if left > wide else x

    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, sliding(hashes, np.minimum), edge]), np.maximum) == hashes)


def paragraphs(text: str, least: int = LEAST, window: int = WINDOW, bands: int = BANDS, rows: int = ROWS, keys: bool = True):
    """(words, kinds, starts, ends, list of key arrays): blocks (kind 0) then paragraphs (kind 1), as word ranges; case is ignored."""
    lines = [s.split() for s in text.lower().split("\n")]
    words = [w for s in lines for w in s]
    n = len(words)
    hashed = word_hashes(words)
    edges = np.array([0, n], np.int64)
    if n > window + 2:
        three = mixed(hashed[:-2] + hashed[1:-1] * ODD[0] + hashed[2:] * ODD[1])
        picks = _least_places(three, window)
        apart = np.diff(picks, prepend=-9) >= 4
        edges = np.concatenate([[0], picks[apart & (picks > 0)], [n]])
    starts, ends = edges[:-1], edges[1:]
    whole = ends > starts
    starts, ends = starts[whole], ends[whole]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    line_end = np.cumsum(sizes)
    line_start = line_end - sizes
    least = max(least, SHINGLE)
    wrapped = np.concatenate([[False], (sizes > 0) & (sizes < least), [False]])
    turn = np.flatnonzero(wrapped[1:] != wrapped[:-1])  # where runs of shorter lines begin, and the lines after them
    if len(turn):
        first, after = turn[::2], turn[1::2]
        alone = np.flatnonzero(~wrapped[1:-1])
        line_start, line_end = np.concatenate([line_start[alone], line_start[first]]), np.concatenate([line_end[alone], line_end[after - 1]])
        order = np.argsort(line_start, kind="stable")
        line_start, line_end = line_start[order], line_end[order]
        sizes = line_end - line_start
    long = sizes >= least
    kinds = np.concatenate([np.zeros(len(starts), np.int8), np.ones(long.sum(), np.int8)])
    found: list[np.ndarray] = []
    if keys and n:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashed * _powers(_BASE, n), dtype=np.uint64)])
        found.append(mixed((sums[ends] - sums[starts]) * _powers(_BACK, n + 1)[starts] + (ends - starts).astype(np.uint64)))
        if long.any():
            shingles = shingle_hashes(hashed)
            cuts = np.stack([line_start[long], line_end[long] - SHINGLE + 1], 1).ravel()
            padded = np.append((shingles >> np.uint64(32)).astype(np.uint32), np.uint32(0))
            step = max(1, 200_000 // len(padded))
            least_of = np.empty((bands * rows, long.sum()), np.uint64)
            for k in range(0, bands * rows, step):
                ordered = padded * _ODD32[k : min(k + step, bands * rows), None] + _ADD32[k : min(k + step, bands * rows), None]
                ordered[:, -1] = _TOP
                least_of[k : k + step] = np.minimum.reduceat(ordered, cuts, axis=1)[:, ::2]
            least_of = least_of.reshape(bands, rows, -1)
            key = np.repeat(_ADD[64 : 64 + bands, None], long.sum(), axis=1)
            for r in range(rows):
                key = mixed(key * ODD[100] + least_of[:, r])
            found.extend(key)
    return words, kinds, np.concatenate([starts, line_start[long]]), np.concatenate([ends, line_end[long]]), found


def _unit(starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A paragraph's number within its document, in order of place: its first word, the word after its last, the kind."""
    return (starts.astype(np.int64) << 32) + (ends.astype(np.int64) << 1) + kinds


def _word_places(text: str, words: list[str]) -> tuple[list[int], list[int]]:
    """Where each word starts and ends in the text, in code points."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if len(text) == sizes.sum() + len(words) - 1 and "\u0130" not in text:  # single separators; only that letter changes length in lower case
        last = np.cumsum(sizes + 1) - 1
        return (last - sizes).tolist(), last.tolist()
    found = [m.span() for m in WORD.finditer(text)]
    return [a for a, _ in found], [b for _, b in found]


def _keys(docs: DataFrame, least: int, window: int, bands: int, rows: int) -> DataFrame:
    """key, doc_id, version, unit of every paragraph and block."""

    def keyed(batches):
        for batch in batches:
            whose, units, found = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                _, kinds, starts, ends, keys = paragraphs(text or "", least, window, bands, rows)
                if keys:
                    unit = _unit(starts, ends, kinds)
                    here = np.concatenate([unit[: len(keys[0])], *[unit[len(keys[0]) :]] * (len(keys) - 1)])
                    units.append(here)
                    found.append(np.concatenate(keys))
                    whose.append(np.full(len(here), i))
            if found:
                at = pa.array(np.concatenate(whose))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column("doc_id").take(at), batch.column("version").take(at), pa.array(np.concatenate(units))], ["key", "doc_id", "version", "unit"])

    return docs.mapInArrow(keyed, f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, version int, unit long")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, version, unit, start, end (code points), t1, t2 (a 128-bit hash of the words) and, of paragraphs, text (the words) of the wanted units."""

    def cut_out(batches):
        for batch in batches:
            whose, units, first, last, digests, texts = [], [], [], [], [], []
            for i, (text, wanted_units) in enumerate(zip(batch.column("text").to_pylist(), batch.column("units"), strict=True)):
                words = text.lower().split()
                begins, ends = _word_places(text, words)
                units_here = wanted_units.values.to_numpy()
                for u in units_here.tolist():
                    a, b = u >> 32, (u & 0xFFFFFFFF) >> 1
                    said = " ".join(words[a:b])
                    first.append(begins[a])
                    last.append(ends[b - 1])
                    digests.append(xxhash.xxh3_128_digest(said))
                    texts.append(said if u & 1 else None)
                units.append(units_here)
                whose.append(np.full(len(units_here), i))
            at = pa.array(np.concatenate([np.empty(0, np.int64), *whose]))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("version").take(at), pa.array(np.concatenate([np.empty(0, np.int64), *units])), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(texts, pa.string())],
                ["doc_id", "version", "unit", "start", "end", "t1", "t2", "text"],
            )

    listed = wanted.groupBy("doc_id", "version").agg(F.collect_set("unit").alias("units"))
    once = docs.join(listed.hint("merge"), ["doc_id", "version"]).select("doc_id", "version", "units", "text").dropDuplicates(["doc_id", "version"])
    return once.mapInArrow(cut_out, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, version int, unit long, start int, end int, t1 long, t2 long, text string")


def _pairs_apart(placed: DataFrame) -> DataFrame:
    """All pairs (src, dst) of nodes that share a key but no root."""
    one, two = placed.select("key", F.col("node").alias("src"), F.col("root").alias("r")), placed.select("key", F.col("node").alias("dst"), F.col("root").alias("s"))
    return one.join(two, "key").where("src < dst and r <> s").select("src", "dst")


def _line_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the distinct lines that links connect; members: (key, node)."""
    ends = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    stars = members.join(ends, "key")
    pairs = stars.where("node <> low").select(F.col("low").alias("src"), F.col("node").alias("dst")).union(stars.where("node <> high and node <> low").select(F.col("node").alias("src"), F.col("high").alias("dst")))
    links = cut(verified(pairs, texts, similarity), "links")
    roots = cut(connected_components(links), "roots")
    placed = cut(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count(F.lit(1)).alias("n")).where("one <> other").select("key", "n")
    apart = placed.join(mixed, "key")
    pairs = _pairs_apart(apart.where(F.col("n") <= CROWD))
    crowd = cut(apart.where(F.col("n") > CROWD).select("key", "node", "root"), "crowd")
    if crowd.isEmpty():
        return connected_components(links.union(verified(pairs, texts, similarity)))
    pivots = crowd.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)))).alias("pivots"))
    stars = crowd.join(pivots, "key").select("node", F.explode("pivots").alias("pivot")).where("node <> pivot").select(F.least("node", "pivot").alias("src"), F.greatest("node", "pivot").alias("dst"))
    links = cut(links.union(verified(pairs.union(stars), texts, similarity)), "more_links")
    roots = cut(connected_components(links), "roots")
    lines = crowd.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(texts, "node")
    return connected_components(links_apart(cut(lines, "crowd_lines"), links, texts, similarity))


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST, window: int = WINDOW, passage: int = PASSAGE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, n_words, kept_doc_id, kind: spans of code points to remove, and a document where the same stays.

    kind: "paragraph" (near or exact copy of an earlier one) or "block" (a run of removed blocks). Overlapping spans of a document are both
    given. Null and empty texts and rows with a null id have none. Rows that repeat an id and its text are one document; rows that share
    an id with another text are told apart by 31 bits of a hash of the text. An empty table gives no rows. Other columns are not read.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("version"), "text")
    keys = cut(_keys(docs, least, window, bands, rows), "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    found = cut(keys.join(shared.hint("shuffle_hash"), "key").distinct(), "found")
    drop(keys)
    units = cut(_cut_out(docs, found.select("doc_id", "version", "unit")), "units")
    place = F.struct("doc_id", "version", "unit")
    kind = F.col("unit").bitwiseAND(F.lit(1))
    same = cut(units.groupBy(kind.alias("kind"), "t1", "t2").agg(F.min(place).alias("node"), F.count(F.lit(1)).alias("n")), "same")
    blocks = same.where("kind = 0 and n > 1").select("kind", "t1", "t2", F.col("node").alias("kept"))
    heads = same.where("kind = 1").select("node")
    lines = cut(units.where("text is not null").select(place.alias("node"), "text").join(heads, "node", "left_semi"), "lines")
    members = found.where(kind == 1).select("key", place.alias("node")).join(heads, "node", "left_semi")
    roots = cut(_line_links(members, lines, similarity), "line_roots")
    firsts = roots.groupBy("root").agg(F.min("node").alias("first"))
    linked = roots.join(firsts, "root").select("node", "first")
    kept_lines = same.where("kind = 1").join(linked, "node", "left").where("n > 1 or first is not null").select("kind", "t1", "t2", F.coalesce("first", "node").alias("kept"))
    kept = blocks.unionAll(kept_lines)
    gone = units.select("doc_id", "version", "unit", "start", "end", "t1", "t2", kind.alias("kind")).join(kept, ["kind", "t1", "t2"]).where("struct(doc_id, version, unit) <> kept")
    gone = gone.select("doc_id", "version", "kind", F.shiftright("unit", 32).cast("int").alias("a"), F.shiftright(F.col("unit").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int").alias("b"), "start", "end", F.col("kept.doc_id").alias("kept_doc_id"))

    id_type = docs.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf(f"array<struct<start:int,end:int,n_words:int,kept_doc_id:{id_type},kind:string>>")
    def runs(found: pd.Series) -> pd.Series:
        out = []
        for spans in found:
            spans = sorted(spans, key=lambda s: (s["kind"], s["a"]))
            merged, run = [], None
            for s in spans:
                if s["kind"] == 1:
                    merged.append({"start": s["start"], "end": s["end"], "n_words": s["b"] - s["a"], "kept_doc_id": s["kept_doc_id"], "kind": "paragraph"})
                elif run and run["b"] == s["a"]:
                    run |= {"b": s["b"], "end": s["end"]}
                else:
                    run = {"a": s["a"], "b": s["b"], "start": s["start"], "end": s["end"], "kept_doc_id": s["kept_doc_id"]}
                    merged.append(run)
            out.append([s if "kind" in s else {"start": s["start"], "end": s["end"], "n_words": s["b"] - s["a"], "kept_doc_id": s["kept_doc_id"], "kind": "block"} for s in merged if "kind" in s or s["b"] - s["a"] >= passage])
        return pd.Series(out, dtype=object)

    each = gone.groupBy("doc_id", "version").agg(F.collect_list(F.struct("kind", "a", "b", "start", "end", "kept_doc_id")).alias("spans"))
    return each.select("doc_id", F.explode(runs("spans")).alias("s")).select("doc_id", "s.*")
