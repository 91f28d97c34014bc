"""SimHash near-duplicates, found by an inverted index on positional bytes.

near_duplicates links 64-bit fingerprints that differ in at most `bits` <= 2 bits, exactly. Such a pair shares at least six of the eight
positional bytes. A list for each single byte would hold 1/256 of all rows, so a posting holds four positional bytes: the 14 quadruples
of positions in which each three positions stand together just once (the planes of the cube). Six shared bytes then are three shared
postings or more, and five are one at most: the postings that a pair shares are tallied, pairs below the guaranteed three go, and the
rest are verified bit by bit.

A posting list of more than `hot` fingerprints would make a quadratic number of pairs. Its fingerprints take another, exact way: two of
them differ in at most two bits just when some value is within one bit of both, so each is listed under itself and its 64 one-bit
neighbours, and all that stand under one value (65 at most) are linked in a star.

similar_documents links documents whose sets of five-word shingles have a Jaccard similarity of `similarity` or more. At 0.8 two
64-bit fingerprints differ in ten bits, so no byte needs to be shared; it takes a wide fingerprint instead (WIDE random projections of
the document's pairs of words, of which one changed word spoils few) and postings of three positional bytes, KEYS of them. Pairs that
share one are filtered by the shared bytes and equal bits of the positions outside all postings, and verified on the shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.llm import similar
from rookery.llm.common import col, cut, drop, fresh, narrow
from rookery.llm.components import connected_components

HOT = 48
PLANES = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Planes that miss any two, one or none of the positions: postings that fingerprints share at least, by the bits they differ in.
GUARANTEED = {2: 3, 1: 7, 0: 14}
#: Projections of the wide fingerprint, bytes of a posting, postings; members of a posting list compared pair by pair, postings whose longer lists
#: have pivots, pivots of such a list, pivots that a member is compared with.
WIDE, BYTES, KEYS, CROWD, STARS, PIVOTS, NEAREST = 2048, 3, 64, 24, 20, 4, 3
#: 16 of the bytes after those in postings: shared bytes at least (a pair at 0.8 shares 4.3 of them), differing bits at most (19 at 0.8, 64 of strangers).
SHARED, APART = 1, 40


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each space-joined run of `words` words (the whole sequence, if shorter); A-Z lower-cased; split at ASCII white space."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, words, seed)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = hashes[k : k + (1 << 16)].astype("<u8", copy=False)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def hashed(batches):
        for batch in batches:
            made = np.array([fingerprint(t or b"", words, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def fingerprint_links(fps: DataFrame, bits: int = 2, hot: int = HOT) -> DataFrame:
    """Edges (src, dst) over distinct fingerprints that connect just those that links of at most `bits` differing bits connect."""
    if bits not in (0, 1, 2):
        raise ValueError("bits must be 0, 1 or 2: the guarantees of the index are for those")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF))
    four = lambda k, c: sum((F.shiftleft(byte(i), 8 * n) for n, i in enumerate(c)), F.shiftleft(F.lit(k).cast("long"), 32))
    postings = fps.select(F.explode(F.array(*(four(k, c) for k, c in enumerate(PLANES)))).alias("key"), "fp")
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = cut(postings.join(sizes, "key"), "postings")
    small = listed.where(F.col("n") <= hot)
    pairs = small.select("key", F.col("fp").alias("src")).join(small.select("key", F.col("fp").alias("dst")), "key").where("src < dst")
    tallied = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("tally")).where(F.col("tally") >= GUARANTEED[bits])
    near = tallied.where(F.bit_count(F.expr("src ^ dst")) <= bits).select("src", "dst")
    crowded = listed.where(F.col("n") > hot).select("fp").distinct()
    centres = crowded.select("fp", F.explode(F.array(F.lit(0).cast("long"), *(F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long") for i in range(64)))).alias("flip"))
    under = centres.select("fp", F.expr("fp ^ flip").alias("centre"))
    if bits < 2:  # a centre within one bit of both says no more than two bits: keep only those at the centre itself and one bit off
        stars = under.alias("u").join(crowded.select(F.col("fp").alias("c")), F.col("u.centre") == F.col("c")).where("u.fp <> c").select(F.col("u.fp").alias("src"), F.col("c").alias("dst")).where(F.lit(bits == 1))
    else:
        stars = under.groupBy("centre").agg(F.collect_list("fp").alias("members")).where("size(members) > 1").select(F.array_min("members").alias("src"), F.explode("members").alias("dst")).where("src <> dst")
    return near.unionAll(stars)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id for every row: component_id is the least doc_id that links reach, the row's own included.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows give repeated rows; rows with a
    null id keep it and never name a component (a component of such rows alone has null). An empty table gives no rows.
    Links are between distinct fingerprints; copies are joined to theirs at the end, so groups of copies cost nothing more.
    """
    rows = cut(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), bits, hot))
    roots = cut(roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least"), "roots")
    firsts = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(firsts, "root").select("fp", "component_id")
    known = distinct.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def _spread(counts: np.ndarray) -> np.ndarray:
    """Each row times the Walsh-Hadamard matrix, as two products with its factors."""
    sign = lambda n: np.array([[(-1.0) ** (i & j).bit_count() for j in range(n)] for i in range(n)])
    left, right = sign(32), sign(WIDE // 32)
    return (left @ (counts.reshape(-1, 32, WIDE // 32) @ right)).reshape(-1, WIDE)


_FLIP = np.random.default_rng(5).choice([-1.0, 1.0], (2, WIDE))
_PLACES = np.random.default_rng(6).permutation(BYTES * KEYS).reshape(KEYS, BYTES)


def wide_fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """WIDE bits, packed, for each set of feature hashes: the signs of random projections of the set's counts in WIDE signed buckets."""
    counts = np.zeros((len(hashes), WIDE))
    for row, found in zip(counts, hashes, strict=True):
        found = np.unique(found)
        row += np.bincount((found % np.uint64(WIDE)).astype(np.int64), np.where(found >> np.uint64(40) & np.uint64(1), 1.0, -1.0), WIDE)
    return np.packbits(_spread(_spread(counts * _FLIP[0]) * _FLIP[1]) > 0, axis=1)


def _sequence(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _indexed(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, w1, w2 (a hash of the words), keys (postings) and s1, s2 (the other bytes) of rows (doc_id, text_hash, text)."""

    def hashed(batches):
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, len(texts), 64):
                words = [_sequence(t) for t in texts.slice(a, 64).to_pylist()]
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), "<i8").reshape(-1, 2)
                pairs = [similar.word_hashes(w) if len(w) < 2 else similar.shingle_hashes(similar.word_hashes(w), 2) for w in words]
                prints = wide_fingerprints(pairs).astype(np.int64)
                keys = np.zeros((len(words), KEYS), np.int64) + (np.arange(KEYS) << 8 * BYTES)
                for n in range(BYTES):
                    keys += prints[:, _PLACES[:, n]] << 8 * n
                rest = np.ascontiguousarray(prints[:, BYTES * KEYS : BYTES * KEYS + 16].astype(np.uint8)).view("<i8")
                held = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays(
                    [held.column("doc_id"), held.column("text_hash"), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), KEYS).cast(pa.list_(pa.int64())), pa.array(rest[:, 0]), pa.array(rest[:, 1])],
                    ["doc_id", "text_hash", "w1", "w2", "keys", "s1", "s2"],
                )

    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, w1 long, w2 long, keys array<long>, s1 long, s2 long")


def _differing() -> Column:
    """Differing bits of the remaining bytes (a1, a2 and b1, b2); null if they agree too little."""
    differ = [F.expr("a1 ^ b1"), F.expr("a2 ^ b2")]
    shared = sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for x in differ for i in range(8))
    bits = F.bit_count(differ[0]) + F.bit_count(differ[1])
    return F.when((bits <= APART) & (shared >= SHARED), bits)


def _document_links(nodes: DataFrame, texts_of, similarity: float) -> DataFrame:
    """(node, root) of nodes (node, keys, s1, s2) that links connect; texts_of(nodes) gives their (node, text).

    Members of a list of more than CROWD are crowded. Each is compared with the NEAREST, by the remaining bytes, of the pivots of some of
    its lists; crowded ones that are then still apart are joined exactly. All other pairs of a list are compared as they are.
    """
    postings = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    long = cut(sizes.where(F.col("n") > CROWD).select("key"), "long")
    crowd = cut(postings.join(long, "key", "left_semi"), "crowd")
    crowded = cut(crowd.select("node").distinct(), "crowded")
    marks = nodes.select("node", "s1", "s2").join(crowded.withColumn("crowd", F.lit(True)), "node", "left").withColumn("crowd", F.col("crowd").isNotNull())
    small = cut(postings.join(sizes.where(F.col("n") <= CROWD).select("key"), "key"), "small").join(marks, "node")
    one = small.select("key", F.col("node").alias("src"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("crowd").alias("c1"))
    two = small.select("key", F.col("node").alias("dst"), F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("crowd").alias("c2"))
    pairs = one.join(two, "key").where("src < dst and not (c1 and c2)").where(_differing().isNotNull()).select("src", "dst").distinct()
    crowd = crowd.where(F.shiftright("key", 8 * BYTES) < STARS).join(nodes.select("node", "s1", "s2"), "node")
    pivots = crowd.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by(F.struct("node", "s1", "s2"), F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)))).alias("pivots"))
    stars = crowd.join(pivots, "key").select(F.col("node").alias("src"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.explode("pivots").alias("p")).select("src", "a1", "a2", F.col("p.node").alias("dst"), F.col("p.s1").alias("b1"), F.col("p.s2").alias("b2")).where("src <> dst")
    ranked = stars.select("src", "dst", _differing().alias("bits")).where("bits is not null").groupBy("src").agg(F.array_sort(F.collect_set(F.struct("bits", "dst"))).alias("best"))  # at most PIVOTS a list
    nearest = ranked.select("src", F.explode(F.slice("best", 1, NEAREST)).alias("b")).select(F.least("src", "b.dst").alias("src"), F.greatest("src", "b.dst").alias("dst"))
    near = cut(pairs.union(nearest.distinct()), "near")
    texts = cut(texts_of(near.select(F.col("src").alias("node")).union(near.select(F.col("dst").alias("node"))).union(crowded).distinct()), "texts")
    links = cut(similar.verified(near, texts, similarity), "links")
    roots = cut(connected_components(links), "roots")
    lines = cut(crowded.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(texts, "node"), "crowd")
    if lines.isEmpty():
        return roots
    return connected_components(similar.links_apart(lines, links, texts, similarity))


def similar_documents(docs: DataFrame, similarity: float = similar.SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, head_id, head_hash for every row: the least (id, hash of the text) that links reach, the row's own included.

    Words are split at ASCII white space and A-Z are lower-cased. Texts of the same words are linked, and texts of five words or more
    whose sets of five-word shingles have that Jaccard similarity; each such pair shares a posting with a probability of 0.998 at 0.8 for
    scattered changes and 0.75 for one inserted block, of 0.99 for a block at 0.9, and members of crowded postings are joined exactly.
    Null, empty and wordless texts have the same words. A null id is an id like any other here, and the least. Repeated rows give
    repeated rows. An empty table gives no rows. Copies are collapsed first, so groups of copies cost nothing more.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    marked = cut(_indexed(rows), "marked")
    once = marked.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.first("keys").alias("keys"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    nodes = cut(once.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once they are written

    def texts_of(wanted: DataFrame) -> DataFrame:
        def plain(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([b" ".join(_sequence(t)).decode() for t in batch.column("text").to_pylist()], pa.string())], ["node", "text"])

        heads = nodes.join(wanted, "node").select("node", F.struct("head.doc_id", "head.text_hash").alias("place"))
        found = rows.withColumn("place", F.struct("doc_id", "text_hash")).join(heads.hint("merge"), "place").select("node", "text")
        return found.mapInArrow(plain, "node long, text string").dropDuplicates(["node"])

    roots = _document_links(nodes.select("node", "keys", "s1", "s2"), texts_of, similarity)
    placed = cut(nodes.select("w1", "w2", "node", "head").join(roots, "node", "left").select("w1", "w2", "head", F.coalesce("root", "node").alias("root")), "placed")
    firsts = placed.groupBy("root").agg(F.min("head").alias("first"))
    known = placed.join(firsts, "root").select("w1", "w2", "first")
    return marked.join(known, ["w1", "w2"]).select("doc_id", "text_hash", F.col("first.doc_id").alias("head_id"), F.col("first.text_hash").alias("head_hash"))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of similar_documents: of the rows with its head's id and text any one, with all its columns."""
    place, turn, head = fresh(docs, "place"), fresh(docs, "turn"), "head"
    heads = found.select(F.struct(F.col("head_id").alias("id"), F.col("head_hash").alias("hash")).alias(head)).distinct()
    marked = docs.withColumn(place, F.struct(col(docs, id_col).alias("id"), F.xxhash64(col(docs, text_col)).alias("hash")))
    both = marked.join(heads.hint("merge"), marked[place] == heads[head], "left_semi")
    return both.withColumn(turn, F.row_number().over(Window.partitionBy(place).orderBy(F.lit(1)))).where(F.col(turn) == 1).drop(place, turn)
