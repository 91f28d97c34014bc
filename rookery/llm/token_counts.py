"""Token counts under a unigram language model, by trie-shared dynamic programming.

Distinct pre-tokens go into a trie of bytes. Each node holds the best score of a segmentation of its prefix into vocabulary
pieces and the number of pieces in it, computed once from its ancestors however many pre-tokens share the prefix; the terminal
node's number is the pre-token's count. A document's count is the sum over its pre-tokens.

The vocabulary comes from a rank file; piece of rank r has log-probability -ln(r + 2) (Zipf). Ties go to fewer pieces.
"""

from __future__ import annotations

import base64
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from rookery.llm.chunks import BLOCK, ChunkValues
from rookery.llm.common import narrow, runs

#: Nodes a worker's trie may have before it starts afresh, and the pre-token length from which nothing is shared: bounds of memory.
NODES, LONG = 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class UnigramTrie:
    """Piece counts of pre-tokens; nodes are [score, pieces, children or None]."""

    def __init__(self, scores: dict[bytes, float], nodes: int = NODES, long: int = LONG):
        self.scores, self.longest, self.limit, self.long = scores, max(map(len, scores), default=1), nodes, long
        self.root: list = [0.0, 0, None]
        self.size = 0

    def _best(self, word: bytes, end: int, path: list) -> tuple[float, int]:
        best, pieces = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            s = self.scores.get(word[start:end])
            if s is not None:
                total, n = path[start][0] + s, path[start][1] + 1
                if total > best or total == best and n < pieces:
                    best, pieces = total, n
        return best, pieces

    def count(self, word: bytes) -> int:
        """Pieces in the best segmentation; a word that has none counts one for each byte."""
        if self.size > self.limit:
            self.root, self.size = [0.0, 0, None], 0
        path, node, share = [self.root], self.root, len(word) <= self.long
        for end, byte in enumerate(word, 1):
            below = node[2] and node[2].get(byte) if share else None
            if below is None:
                below = [*self._best(word, end, path), None]
                if share:
                    if node[2] is None:
                        node[2] = {}
                    node[2][byte] = below
                    self.size += 1
            node = below
            path.append(node)
        return node[1] if node[0] > -math.inf else len(word)


_MADE: dict = {}


def _counter(path: str, pattern: str) -> ChunkValues:
    if (path, pattern) not in _MADE:
        import regex

        find = regex.compile(pattern).findall
        trie = UnigramTrie({piece: -math.log(rank + 2) for piece, rank in read_ranks(path).items()})

        def encode(chunks: list[str]) -> list[tuple[int, int]]:
            found = [find(c) for c in chunks]
            counts = {w: trie.count(w.encode()) for w in sorted({w for words in found for w in words})}
            return [(sum(counts[w] for w in words), len(words)) for words in found]

        _MADE[path, pattern] = ChunkValues(pattern, encode, lambda pairs: tuple(map(sum, zip(*pairs, strict=True))) or (0, 0))
    return _MADE[path, pattern]


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_bytes for every row, over whole texts.

    Null and empty texts count 0; repeated rows give repeated rows; an empty table gives none; other columns are not read.
    Nothing is shuffled: a document's counts need only the document.
    """

    def counted(batches):
        counter = _counter(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pairs = []
            for a, b in runs([len(t) for t in texts], BLOCK):
                pairs += counter.values(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_pretokens long, n_bytes long")
