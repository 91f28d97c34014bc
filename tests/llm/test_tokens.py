import base64
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rookery.llm import bpe_codec, orc_ids, packing, token_counts
from rookery.llm.chunks import LibraryIds, packed
from rookery.llm.queries import QUERIES, RANKS, TOKENIZER


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


@pytest.fixture(scope="module")
def tik(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


IDS = LibraryIds(TOKENIZER, P.PATTERN, limit=40)
ALPHABET = st.sampled_from([*" \n\t\r\x0b\x1c\x85\xa0", "  ", "\n\n", " \n", "a", "Bc", "'s", "'", "1", "²", ".", "é", "ª", "\xad", "œ", "’", "\x7f", "中", "　", "▁"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=14).map("".join) | st.none(), max_size=4))
def test_chunks_equal_the_library(texts):
    offsets, ids = IDS.ids(pa.array(texts, pa.string()), 2)
    assert len(offsets) == len(texts) + 1 and offsets[-1] == len(ids)
    expected = [packed([*IDS.library.encode(t or "", add_special_tokens=False).ids, 2]) for t in texts]
    assert [ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)] == expected


def test_op5_equals_tiktoken(spark, sf, texts, tik):
    got = {r.doc_id: r for r in QUERIES["op5_bpe_codec"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = tik.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_codec_edges(odd, none, tik, ranks):
    rows = [(r.text or "", r.ids) for r in odd.select("doc_id", "text").join(bpe_codec.bpe_encode(odd, RANKS, P.PATTERN).where("doc_id <> 8").dropDuplicates(["doc_id"]), "doc_id").collect()]
    assert len(rows) > 20
    for text, ids in rows:
        assert ids == tik.encode_ordinary(text)
    decoded = bpe_codec.bpe_decode(bpe_codec.bpe_encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((r.text or "").encode() for r in odd.collect())
    assert bpe_codec.bpe_digests(none, RANKS, P.PATTERN).count() == 0


def slow_count(word: bytes, scores: dict) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max(((best[a][0] + scores[word[a:end]], -(best[a][1] + 1)) for a in range(end) if word[a:end] in scores), default=(-math.inf, 0)))
        best[-1] = (best[-1][0], -best[-1][1])
    return best[-1][1]


def test_op1_equals_plain_viterbi(spark, sf, texts, ranks):
    scores = {p: -math.log(r + 2) for p, r in ranks.items()}
    find, known = regex.compile(P.PATTERN).findall, {}
    got = {r.doc_id: r for r in QUERIES["op1_token_counts"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = [w.encode() for w in find(text)]
        for w in words:
            if w not in known:
                known[w] = slow_count(w, scores)
        assert (got[i].n_tokens, got[i].n_pretokens) == (sum(known[w] for w in words), len(words))


def test_trie_shares_and_forgets():
    scores = {b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"abc": -9.0, b"c": -1.0}
    trie = token_counts.UnigramTrie(scores, nodes=3, long=4)
    assert [trie.count(w) for w in (b"ab", b"abc", b"abab", b"ababab", b"d", b"")] == [1, 2, 2, 3, 1, 0]


def test_token_count_edges(odd, none):
    got = token_counts.token_counts(odd, RANKS, P.PATTERN).collect()
    assert len(got) == odd.count()
    assert all(r.n_tokens == 0 for r in got if r.n_bytes == 0)
    assert token_counts.token_counts(none, RANKS, P.PATTERN).count() == 0


def check_packing(rows, texts, tok, capacity=1024):
    """Every document's pieces in order and whole, checksums right, sequences gapless and not over full."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            assert r.length == capacity or n == 0
            at += r.length
        assert at == len(ids)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_op6_packs_well(spark, sf, texts, tok):
    rows = QUERIES["op6_best_fit_packing"](spark, sf).collect()
    used = check_packing(rows, texts, tok)
    lengths = sorted((r.length for r in rows), reverse=True)
    assert used <= max(-(-sum(lengths) // 1024), sum(n > 512 for n in lengths)) * 1.03 + 1


def test_packing_rounds(docs, texts, tok):
    """Tiny tasks force several rounds and several last tasks."""
    rows = packing.best_fit_packing(docs.repartition(9), TOKENIZER, P.PATTERN, items=40, fan_in=2).collect()
    check_packing(rows, texts, tok)


def test_packing_edges(odd, none, spark, tok):
    single = odd.dropDuplicates(["doc_id"]).where("doc_id <> 8")
    check_packing(packing.best_fit_packing(single, TOKENIZER, P.PATTERN).collect(), {r.doc_id: r.text for r in single.collect()}, tok)
    assert packing.best_fit_packing(odd, TOKENIZER, P.PATTERN).where("piece = 0").count() == odd.count()
    assert packing.best_fit_packing(none, TOKENIZER, P.PATTERN).count() == 0


def test_best_fit_fills_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(fills) == [10, 10]
    assert packing.best_fit(np.array([], dtype=np.int64), 10) == ([], [], [])


def test_op8_reads_back_what_was_written(spark, sf, texts, tok):
    got = {r.doc_id: r for r in QUERIES["op8_orc_token_ids"](spark, sf).collect()}
    start = 0
    for i in sorted(texts):
        ids = tok.encode(texts[i], add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_orc_files(docs, odd, none, spark, tmp_path, tok):
    from pyarrow import orc

    schema = orc_ids.write_token_ids(docs, f"file://{tmp_path}/ids", TOKENIZER, P.PATTERN, partitions=3)
    files = sorted((tmp_path / "ids").glob("*.orc"))
    read = [orc.ORCFile(str(f)).read(["doc_id"]).column(0).to_pylist() for f in files]
    assert len(files) == 3 and [x for ids in read for x in ids] == sorted(r.doc_id for r in docs.collect())
    back = orc_ids.read_token_ids(spark, f"file://{tmp_path}/ids", schema)
    assert back.where("doc_id = 17").collect()[0].ids == tok.encode(docs.where("doc_id = 17").first().text, add_special_tokens=False).ids + [2]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in back.where("doc_id = 17")._jdf.queryExecution().toString()
    schema = orc_ids.write_token_ids(odd, f"file://{tmp_path}/odd", TOKENIZER, P.PATTERN)
    got = orc_ids.token_id_digests(orc_ids.read_token_ids(spark, f"file://{tmp_path}/odd", schema)).orderBy("start").collect()
    assert len(got) == odd.count() and [r.doc_id is None for r in got[:2]] == [True, True]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    schema = orc_ids.write_token_ids(none, f"file://{tmp_path}/none", TOKENIZER, P.PATTERN)
    assert orc_ids.token_id_digests(orc_ids.read_token_ids(spark, f"file://{tmp_path}/none", schema)).count() == 0


def test_orc_indexes_bloom_filters_and_encoding(docs, spark, tmp_path):
    """What the files hold, read by the ORC library itself: row indexes, a Bloom filter of document ids, run-length encoded integers."""
    orc_ids.write_token_ids(docs, f"file://{tmp_path}/ids", TOKENIZER, P.PATTERN, partitions=2)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    seen = set()
    for file in sorted((tmp_path / "ids").glob("*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        names = [*reader.getSchema().getFieldNames()]
        column = names.index("doc_id") + 1
        wanted = gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
        wanted[column] = True
        rows = reader.rows()
        for i, stripe in enumerate(reader.getStripes()):
            assert stripe.getDataLength() <= 16 << 20 and stripe.getIndexLength() > 0
            index = rows.readRowIndex(i, None, wanted)
            bloom = index.getBloomFilterIndex()[column]
            assert bloom.getBloomFilterCount() == index.getRowGroupIndex()[column].getEntryCount() >= 1
            kinds = [c.getKind().toString() for c in rows.readStripeFooter(stripe).getColumnsList()]
            assert kinds[column] == kinds[names.index("ids") + 2] == "DIRECT_V2"
            seen.add(file.name)
        rows.close()
    assert len(seen) == 2
