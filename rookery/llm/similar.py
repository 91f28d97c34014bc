"""Jaccard similarity of five-word shingle sets: verification of pairs, and an exact join for crowds that any index would fill with pairs.

Texts here are words with single spaces between them. A node is anything with an order that names a text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.llm.common import cut
from rookery.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: Buckets that count shingles; side of a cell of comparisons; pivots of a rare shingle, and of them those that a line is compared with.
BUCKETS, BLOCK, PIVOTS, CLOSEST = 1 << 18, 1024, 3, 64
#: Words whose hashes a worker remembers: about 25 MB.
REMEMBERED = 1 << 17
ODD = np.random.default_rng(7).integers(1 << 62, (1 << 63) - 1, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS: dict = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list) -> np.ndarray:
    """Of strings or of bytes; a bounded number of words is remembered."""
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    new = set(words).difference(_WORDS)
    _WORDS.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashed: np.ndarray, words: int = SHINGLE) -> np.ndarray:
    """A hash of each run of `words` words; none if there are fewer."""
    n = len(hashed) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = hashed[:n].copy()
    for j in range(1, words):
        out += hashed[j : n + j] * ODD[j + 1]
    return mixed(out)


def jaccard(a: str, b: str) -> float:
    """Of the sets of five-word shingles; texts of fewer words are alike only if they are equal."""
    x, y = ({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for w in (a.split(" "), b.split(" ")))
    return len(x & y) / len(x | y) if x and y else float(a == b)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (src, dst) whose texts (node, text) are at least that similar."""

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)])

    one = texts.select(F.col("node").alias("src"), F.col("text").alias("a"))
    two = texts.select(F.col("node").alias("dst"), F.col("text").alias("b"))
    return pairs.distinct().join(one, "src").join(two, "dst").where(similar("a", "b") >= similarity).select("src", "dst")


def _prefixes(lines: DataFrame, similarity: float) -> DataFrame:
    """token, at, size, short, node, root of the rarest shingles of (node, text, root), as many as a similar line must share one of.

    Rarity is that of a bucket of shingles, so the counts have a bounded size; any order is exact, a good one gives few candidates.
    short: also among those that a line shares with a similar one of at least its own size.
    """

    def counted(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(counts, (np.unique(shingle_hashes(word_hashes(text.split(" ")))) >> np.uint64(40)).astype(np.int64) % BUCKETS, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    common = np.zeros(BUCKETS, np.int64)
    for r in lines.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        common[r["bucket"]] = r["n"]

    def cut_short(batches):
        for batch in batches:
            whose, columns = [], [[], [], [], []]
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens = np.unique(shingle_hashes(word_hashes(text.split(" "))))
                n = len(tokens)
                most = n - math.ceil(similarity * n - 1e-9) + 1
                few = n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1
                rare = tokens[np.lexsort((tokens, common[(tokens >> np.uint64(40)).astype(np.int64) % BUCKETS]))[:most]]
                whose.append(np.full(len(rare), i))
                for column, x in zip(columns, (rare.view(np.int64), np.arange(len(rare), dtype=np.int32), np.full(len(rare), n, np.int32), np.arange(len(rare)) < few), strict=True):
                    column.append(x)
            if whose:
                at = pa.array(np.concatenate(whose))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in columns), batch.column("node").take(at), batch.column("root").take(at)], ["token", "at", "size", "short", "node", "root"])

    kind = lines.schema["node"].dataType.simpleString()
    return lines.select("node", "text", "root").mapInArrow(cut_short, f"token long, at int, size int, short boolean, node {kind}, root {kind}")


def _mixed_tokens(listed: DataFrame) -> DataFrame:
    """token, n of those that stand for lines of different roots and, for one of them, among the first."""
    return listed.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("some"), F.min("root").alias("one"), F.max("root").alias("other")).where("some and n > 1 and one <> other").select("token", "n")


def _fits(similarity: float) -> str:
    """Whether two lines' sizes, and what both have left from the place of a shared shingle on, allow the similarity."""
    share = similarity / (1 + similarity)
    return f"least(size, size2) >= {similarity}D * greatest(size, size2) - 1e-9D and least(size - at, size2 - at2) >= {share}D * (size + size2) - 1e-9D"


def _nearest_pivots(listed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst) of each line and the CLOSEST, by shared rare shingles, of a few pivots of each of those: no more rows than listed has, times PIVOTS."""
    held = listed.join(_mixed_tokens(listed).select("token"), "token")
    # The earlier a line has the shingle, the fewer rarer ones of its own it has: it stands in the middle of its family.
    least = lambda i: F.min_by(F.struct("node", "root", "size", "at"), F.struct("at", F.xxhash64("node", F.lit(i), "token")))
    pivots = held.groupBy("token").agg(F.array_distinct(F.array(*(least(i) for i in range(PIVOTS)))).alias("pivots"))
    stars = held.join(pivots, "token").select("node", "root", "size", "at", F.explode("pivots").alias("p")).select("node", "root", "size", "at", F.col("p.node").alias("node2"), F.col("p.root").alias("root2"), F.col("p.size").alias("size2"), F.col("p.at").alias("at2"))
    tallied = stars.where("root <> root2").where(_fits(similarity)).groupBy("node", "node2").agg(F.count(F.lit(1)).alias("tally"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("tally"), "node2"))
    near = tallied.withColumn("rank", rank).where(F.col("rank") <= CLOSEST)
    return near.select(F.least("node", "node2").alias("src"), F.greatest("node", "node2").alias("dst"))


def _pairs_apart(listed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst) of different roots: all at least that similar, and some that are not.

    Similar sets share one of their rarest members, and from the first shared one on both have enough left (prefix and position filter).
    The members under one shingle are compared in cells of BLOCK by BLOCK.
    """
    sizes = _mixed_tokens(listed).select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    parts = cut(listed.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("node"), "parts")), "parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("other")
    one = parts.where("short").select("token", "at", "size", F.col("node").alias("a"), F.col("root").alias("r"), F.col("part"), every)
    two = parts.select("token", F.col("at").alias("at2"), F.col("size").alias("size2"), F.col("node").alias("b"), F.col("root").alias("s"), F.col("part").alias("other"), every.alias("part"))
    near = f"r <> s and (size < size2 or size = size2 and a < b) and {_fits(similarity)}"
    return one.join(two, ["token", "part", "other"]).where(near).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def links_apart(lines: DataFrame, links: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """links (src, dst), and links between lines (node, text, root; root: of the components of links) so that all that any pairs link is connected.

    One link joins a line to a component, so each line is first compared with a bounded number of others that share its rare shingles.
    What is still apart then is joined exactly: no link between components is lost.
    """
    listed = cut(_prefixes(lines, similarity), "prefixes")
    more = cut(links.union(verified(_nearest_pivots(listed, similarity), texts, similarity)), "more_links")
    roots = cut(connected_components(more), "roots")
    placed = cut(listed.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    return more.union(verified(_pairs_apart(placed, similarity), texts, similarity))
