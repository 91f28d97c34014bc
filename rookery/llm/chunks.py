"""Fast whole-text tokenisation: a text falls into chunks at single spaces and newlines, and values of chunks are remembered.

The pre-tokenisation pattern always starts a new match at a space that is followed by something other than white space, and
at a newline followed by such; so a text's value is the concatenation (or sum) of its chunks' values. Chunks where white
space runs on are not so simple: a text that has one goes the slow way, match by match.
"""

from __future__ import annotations

from array import array
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from rookery.llm.common import runs

#: Entries a worker remembers before it starts afresh (about 200 bytes each): bounds memory, changes no result.
CACHE = 700_000
#: The first character beyond Latin-1: all libraries agree on the kinds of those before it.
LATIN = "\u0100"
#: Characters split at once.
BLOCK = 1_000_000


class ChunkValues:
    """Sums, by `join`, the values `encode` gives to pieces of text; encode takes a list of strings, each a run of whole matches."""

    def __init__(self, pattern: str, encode, join, limit: int = CACHE):
        self.find, self.encode, self.join, self.limit = regex.compile(pattern).findall, encode, join, limit
        self.tail: dict = {}
        self.whole: dict = {}
        self.held = 0

    @staticmethod
    def _simple(chunk: str) -> bool:
        rest = chunk[1:2] if chunk[:1] == "\n" else chunk[:1]
        return bool(rest) and not rest.isspace()

    def _learn(self, known: dict, new: list[str], values) -> None:
        if new:
            known.update(zip(new, values, strict=True))
            self.held += sum(map(len, new))

    def _slow(self, text: str):
        found = self.find(text)
        new = list(set(found).difference(self.whole))
        self._learn(self.whole, new, self.encode(new))
        return self.join(map(self.whole.__getitem__, found))

    def values(self, texts: list[str]) -> list:
        """One value for each text; about a megabyte of them at a time is best."""
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        tail, whole = self.tail, self.whole
        if len(tail) + len(whole) > self.limit or self.held > 16 * self.limit:
            tail.clear()
            whole.clear()
            self.held = 0
        seen: set = set()
        for parts in split:
            seen.update(parts[1:])
        new = [c for c in seen.difference(tail) if self._simple(c)]
        self._learn(tail, new, self.encode([c if c[0] == "\n" else " " + c for c in new]))
        heads = [p[0] for p in split]
        new = [h for h in set(heads).difference(whole) if h]
        self._learn(whole, new, self.encode(new))
        out = []
        for text, parts, head in zip(texts, split, heads, strict=True):
            try:
                out.append(self.join([whole[head], *map(tail.__getitem__, parts[1:])]) if head else self._slow(text))
            except KeyError:
                out.append(self._slow(text))
        return out


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class _Remembered(dict):
    """Values by text; one that is missing comes from those remembered before, or is made."""

    def __init__(self, make, older: dict):
        self.make, self.older = make, older

    def __missing__(self, text: str):
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
        self[text] = value
        return value


class LibraryIds:
    """Ids of whole texts by the tokenizers library, without special tokens.

    Each distinct chunk of a block of texts is looked up once; one that is new and of printable Latin-1 characters falls into matches
    here, and the library's model gets each match. Any other goes to the library whole, since libraries differ in which rare characters
    they call letters or white space. Of the chunks remembered, the later half outlives the earlier.
    """

    def __init__(self, path: str, pattern: str, limit: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from rookery.llm.bpe_codec import byte_characters

        self.library, self.find, self.limit = Tokenizer.from_file(path), regex.compile(pattern).findall, limit
        self.library.encode_special_tokens = True
        self.model, self.to_characters = self.library.model, dict(enumerate(byte_characters()))
        self.bytes_of = [packed([i]) for i in range(self.library.get_vocab_size())]
        self.tail, self.held = _Remembered(self._chunk, {}), 0
        self.whole, self.marks = _Remembered(self._run, {}), _Remembered(self._run, {})
        self.newline = self._run("\n")

    def _run(self, text: str) -> bytes:
        self.held += len(text)
        return packed(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _match(self, text: str) -> bytes:
        mapped = text.encode().decode("latin-1").translate(self.to_characters)
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(mapped)])

    def _chunk(self, chunk: str) -> bytes | None:
        """What follows a space; a chunk that begins with a newline stands for itself. None where white space runs on."""
        if not ChunkValues._simple(chunk):
            return None
        self.held += len(chunk)
        stem = chunk.rstrip(punctuation)
        if len(stem) < len(chunk) and stem[-1:].isalnum() and stem[-1] < LATIN:  # the marks after a letter or digit start a match
            return self.tail[stem] + self.marks[chunk[len(stem) :]]
        lead, text = (self.newline, chunk[1:]) if chunk[0] == "\n" else (b"", " " + chunk)
        if not text.isprintable() or max(text) >= LATIN:
            return self._run("\n" + text if lead else text)
        if chunk.isalpha():
            return self._match(text)
        return lead + b"".join(map(self._match, self.find(text)))

    def _slow(self, text: str) -> bytes:
        return b"".join(map(self.whole.__getitem__, self.find(text)))

    def _forget(self) -> None:
        if 2 * (len(self.tail) + len(self.whole)) > self.limit or self.held > 8 * self.limit:
            self.tail = _Remembered(self._chunk, dict(self.tail))
            self.whole.clear()
            self.marks.clear()
            self.held = 0

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i, with end_id after them, are ids[offsets[i]:offsets[i + 1]]. A null text is as an empty one."""
        self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        index, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)
        heads = distinct[index[at[:-1]]].tolist()
        values = list(map(self.tail.__getitem__, distinct.tolist()))
        hard = np.array([v is None for v in values], bool)[index]
        hard[at[:-1]] = False
        firsts = [self.whole[h] if h else b"" for h in heads]
        none = len(values)
        for i in np.unique(np.searchsorted(at, np.flatnonzero(hard), "right") - 1).tolist():
            firsts[i] = self._slow(texts[i].as_py())
            index[at[i] : at[i + 1]] = none
        index[at[:-1]] = none + 1 + np.arange(len(heads))
        values = [v or b"" for v in values] + [b"", *firsts]

        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool = np.frombuffer(b"".join(values), "<u4")
        n = sizes[index]
        ends = np.cumsum(n)
        found = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - n), n)]
        offsets = np.concatenate([[0], ends])[at]
        return offsets + np.arange(len(offsets)), np.insert(found, offsets[1:], end_id)

    def blocks(self, texts: pa.Array, end_id: int):
        """(start, end, offsets, ids) of consecutive texts, about four megabytes of them at a time."""
        for a, b in runs(pc.binary_length(texts).fill_null(0).to_pylist(), 4 * BLOCK):
            yield a, b, *self.ids(texts.slice(a, b - a), end_id)


_MADE: dict = {}


def library_ids(path: str, pattern: str) -> LibraryIds:
    """One for each worker process, kept from task to task."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = LibraryIds(path, pattern)
    return _MADE[path, pattern]
