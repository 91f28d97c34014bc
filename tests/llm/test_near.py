import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from rookery.llm import components, simhash, vptree
from rookery.llm.queries import QUERIES


def roots_of(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    items = [*fps.items()]
    links = [(a, b) for i, (a, x) in enumerate(items) for b, y in items[:i] if (x ^ y).bit_count() <= 2]
    found = roots_of(links)
    return {i: found.get(i, i) for i in fps}


def test_op7_equals_brute_force(spark, sf, texts):
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = slow_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("hot", [1, 3, 48])
def test_links_of_crowded_postings(spark, hot):
    """Families of fingerprints a few bits apart: chains, stars and strangers, by either way."""
    dice = random.Random(hot)
    fps = set()
    for _ in range(12):
        x = dice.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for _ in range(dice.choice([1, 2, 2, 3])):
                x ^= 1 << dice.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, hot)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    unsigned = lambda f: f & (1 << 64) - 1
    want = roots_of([(a, b) for i, a in enumerate(signed) for b in signed[:i] if (unsigned(a) ^ unsigned(b)).bit_count() <= 2])
    assert got.keys() == want.keys()
    assert len({(got[x], want[x]) for x in got}) == len(set(got.values())) == len(set(want.values()))


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7, 6)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs + [(None, 3)], "src long, dst long")).collect()}
    want = roots_of([p for p in pairs if p[0] != p[1]])
    assert got.keys() == want.keys() and len({(got[x], want[x]) for x in got}) == 2
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_planes_tell_six_shared_bytes_from_five():
    planes = [set(c) for c in simhash.PLANES]
    for n in range(9):
        for spoiled in combinations(range(8), n):
            shared = sum(not c & {*spoiled} for c in planes)
            assert shared >= 3 if n <= 2 else shared <= 1


def test_simhash_edges(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = {r.doc_id: slow_fingerprint(r.text) for r in odd.where("doc_id is not null and doc_id <> 8").collect()}
    assert all(r.fp & (1 << 64) - 1 == want[r.doc_id] for r in got if r.doc_id in want)
    assert {r.component_id for r in got if r.fp == 0} == {0}
    assert simhash.near_duplicates(none).count() == 0


def slow_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def slow_similar(texts):
    """Components of equal word sequences and of Jaccard similarity 0.8 or more, by all pairs."""
    seen = {i: slow_words(t) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in seen.items()}
    ids = sorted(texts, key=lambda i: len(sets[i]))
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 0.8 * len(sets[b]) > len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if seen[a] == seen[b] or sets[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    found = roots_of(links)
    return {i: found.get(i, i) for i in texts}


def test_similar_documents_equal_all_pairs(spark, docs, texts):
    got = {r.doc_id: r.head_id for r in simhash.similar_documents(docs).collect()}
    want = slow_similar(texts)
    assert got.keys() == want.keys() and len({*want.values()}) < len(want)
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)
    kept = simhash.keep_one(docs, simhash.similar_documents(docs))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {*got.values()} and kept.count() == len({*got.values()})


def test_crowds_of_similar_documents_equal_all_pairs(spark):
    """Families of a template a little below the threshold, with near copies among them; families far above it; copies."""
    dice = random.Random(4)
    word = lambda: f"w{dice.randrange(10**6)}"
    base, rows = [word() for _ in range(200)], []
    for _ in range(150):
        own = [*base]
        for at in dice.sample(range(5, 120), 4):
            own[at] = word()
        rows.append(own)
    for i in range(0, 150, 3):
        own = [*rows[i]]
        own[160 + i % 30] = word()
        rows.append(own)
    base = [word() for _ in range(150)]
    for i in range(120):
        own = [*base]
        own[i] = word()
        rows.append(own)
    rows += [rows[0]] * 200 + [[word() for _ in range(90)] for _ in range(60)]
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.head_id for r in simhash.similar_documents(docs).collect()} == slow_similar(texts)


def test_similar_edges(odd, none):
    """Rows with a null id count; of repeated rows, and of rows of one id, one of the group stays."""
    awkward = odd.selectExpr("*", "1 as place", "2 as turn", "3 as head", "4 as root", "5 as node", "6 as w1")
    found = simhash.similar_documents(awkward)
    assert found.count() == odd.count()
    kept = simhash.keep_one(awkward, found)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    assert sum(not slow_words(r.text) for r in rows) == 1
    assert len(rows) == len({(r.head_id, r.head_hash) for r in found.collect()})
    assert [r.doc_id for r in rows if r.text and r.text.startswith("another")] == [8]
    assert simhash.similar_documents(none).count() == 0 and simhash.keep_one(none, simhash.similar_documents(none)).count() == 0


def exact(vectors, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out[q] = d
    return out


def rows_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard", [60, 4096])
def test_factor_one_is_exact(spark, sf, shard):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = rows_of(vptree.nearest_neighbours(vectors, vectors.where("vec_id % 10 = 0"), shard=shard))
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = exact(rows, [r for r in rows if r[0] % 10 == 0], 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-14)


def test_repeated_ids_equal_points_and_ties(spark):
    """One id with a third of all rows, at its own points and at others'; copies of one vector under many ids; few distinct distances."""
    dice = random.Random(8)
    rows = [(i, [float(dice.randrange(3)) for _ in range(4)]) for i in range(400)]
    rows += [(1, [float(dice.randrange(3)) for _ in range(4)]) for _ in range(200)] + [(1, rows[9][1])] * 60
    rows += [(1000 + i, rows[5][1]) for i in range(90)]
    rows += [(2000 + i, [2.0 * (j == i % 4) for j in range(4)]) for i in range(80)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    distinct = {(i, tuple(v)) for i, v in rows if any(v)}
    asked = {i: min(v for j, v in distinct if j == i) for i in {i for i, _ in distinct} if i % 7 == 0 or i == 1}
    queries = spark.createDataFrame([(i, list(v)) for i, v in asked.items()], "vec_id long, embedding array<float>")
    for shard in (50, 4096):
        got = rows_of(vptree.nearest_neighbours(vectors, queries, k=10, shard=shard))
        for q, v in asked.items():
            best = {}
            for i, w in distinct:
                if i != q:
                    d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                    best[i] = min(best.get(i, d), d)
            assert got[q] == sorted((d, i) for i, d in best.items())[:10]


def test_search_reaches_past_points_of_one_id():
    """k + 1 points of one id name only one: more points are asked for."""
    points = np.array([[float(i), 1.0] for i in range(60)])
    first = np.array([7] * 50 + [*range(100, 110)])
    tree = vptree.VantageTree(points, first, leaf=8)
    rows, ids, d = vptree.search_tree(tree, first, np.arange(61), np.array([[0.0, 1.0]]), np.array([0]), np.array([np.inf]), 5, 1.0)
    assert ids.tolist() == [7, 100, 101, 102, 103] and d.tolist() == [0.0, 50.0, 51.0, 52.0, 53.0]


@pytest.mark.parametrize("shard", [100, 4096])
def test_op4_recall(spark, shard):
    """With the query's factor, in many small cells as in one."""
    from rookery.llm.queries import RELAX

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = rows_of(vptree.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), k=10, relax=RELAX, shard=shard))
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    matrix, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    hits = 0
    for q in got:
        d = np.sqrt(((matrix - matrix[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len({i for _, i in got[q]} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(got) == sum(i % 100 == 0 for i in ids) and hits / 10 / len(got) >= 0.95


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 40)] + [(100, [1.0, 2.5]), (101, [3.0, 3.0]), (7, [1.0, 2.0]), (50, None), (51, [0.0, 0.0]), (52, [nan, 1.0]), (53, [inf, 1.0]), (54, [None, 1.0]), (55, []), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (300, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as id", "1 as shard", "2 as block", "3 as vector", "4 as dims", "5 as n", "6 as cell", "7 as first", "8 as ids")
    got = rows_of(vptree.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0 or vec_id = 7"), k=10))
    assert got[0] == [(0.0, i) for i in range(1, 11)]
    assert got[7] == [(0.0, i) for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10)]
    assert got[100] == [(0.5, i) for i in range(10)]
    assert got[200] == [(0.0, 300)] and set(got) == {0, 7, 100, 200, 300}
    assert vptree.nearest_neighbours(vectors.where("false"), vectors).count() == 0
    assert vptree.nearest_neighbours(vectors, vectors.where("false")).count() == 0
