"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 7).

A text is cut into pre-tokens by the vocabulary's pattern, and each pre-token is merged on its own by a rank queue: the
merge ranks are a hierarchical bitmap (three levels of 64-bit words), each set bit owning a bucket of linked-list
positions. Finding the next merge is three find-first-set operations, a merge touches two neighbours, and entries that a
merge has made stale are skipped when met, so a pre-token of n bytes costs O(n) queue steps however long it is (a
megabyte without a blank is no special case). Results of short pre-tokens are kept in a bounded table a worker.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from detlake.session import spread

VOCABULARY = os.environ.get("DETLAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: the public vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens up to so many characters are remembered, and so many of them; a full table is emptied.
KEPT_LENGTH, KEPT = 32, 200_000


class RankQueue:
    """Merges of one pre-token at a time, lowest rank first and leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        words = (max(ranks.values(), default=0) >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0
        if len(self.mid) > 64:
            raise ValueError("three levels hold 262,144 ranks")

    def _set(self, rank: int) -> None:
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def _clear(self, rank: int) -> None:
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[word >> 6] &= ~(1 << (word & 63))
            if not self.mid[word >> 6]:
                self.top &= ~(1 << (word >> 6))

    def _least(self) -> int:
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        w = (t << 6) | ((m & -m).bit_length() - 1)
        x = self.low[w]
        return (w << 6) | ((x & -x).bit_length() - 1)

    def encode(self, data: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        end = list(range(1, n + 1))  # of the symbol that begins here
        before = list(range(-1, n - 1))
        current = [-1] * n  # rank of the pair that begins here; -1 also where no symbol begins
        buckets: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                current[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    self._set(r)
        while self.top:
            rank = self._least()
            places = buckets.pop(rank)
            self._clear(rank)
            places.sort(reverse=True)
            while places:
                i = places.pop()
                if current[i] != rank:
                    continue  # stale
                j = end[i]
                k = end[j]
                end[i] = k
                current[j] = -1
                if k < n:
                    before[k] = i
                earlier = False
                for left, right in ((i, k), (before[i], i)):
                    if left < 0:
                        continue
                    r = ranks.get(data[left : end[right]]) if right < n else None
                    current[left] = -1 if r is None else r
                    if r is not None:
                        if r in buckets:
                            buckets[r].append(left)
                        else:
                            buckets[r] = [left]
                            self._set(r)
                        earlier |= r < rank
                if earlier and places:
                    if rank in buckets:
                        buckets[rank].extend(places)
                    else:
                        buckets[rank] = places
                        self._set(rank)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out


def _splitters():
    """Pre-tokenisers for texts of ASCII only and for any text, equal to PATTERN.

    The standard library's matcher is the faster one but knows no classes of letters and numbers, so these are asked
    of the pattern library once a process. Runs of ASCII that end before another ASCII character come first: they are
    whole pre-tokens whatever the full classes hold.
    """
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    members = lambda p: "".join(f"{re.escape(m[0])}-{re.escape(m[-1])}" for m in regex.findall(p, every))
    letter, number, space = (members(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+"))
    tail = lambda l, n, s: rf" ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
    short = r"'(?:s|t|re|ve|m|ll|d)"
    plain = rf"{short}|" + tail("A-Za-z", "0-9", r" \t\n\r\x0b\x0c")
    end = r"(?![^\x00-\x7f])"
    mixed = rf" ?[A-Za-z]++{end}| ?[0-9]++{end}|{short}| ?[!-/:-@\[-`{{-~]++(?![^ -~])|" + tail(letter, number, space)
    return re.compile(plain).findall, re.compile(mixed).findall


class _Memo(dict):
    def __init__(self, queue: RankQueue):
        self.queue = queue

    def __missing__(self, piece: str) -> list[int]:
        found = self.queue.encode(piece.encode())
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.plain, self.mixed = _splitters()
        self.memo = _Memo(RankQueue(self.ranks))
        self.lookup = self.memo.__getitem__

    def pieces(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() else self.mixed(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts. A special token's string is ordinary text."""
        return list(chain.from_iterable(map(self.lookup, self.pieces(text)))) if text else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The worker's encoder of a vocabulary file (made once a process)."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Texts and characters that go out in one batch at most (a text longer than that goes alone).
_BATCH_TEXTS, _BATCH_CHARS = 512, 2_000_000


def portions(batch: pa.RecordBatch, text: int):
    """(rows before, texts) in portions of bounded size."""
    texts, begin, chars = [], 0, 0
    for i in range(batch.num_rows):
        t = batch.column(text)[i].as_py()
        if texts and (len(texts) >= _BATCH_TEXTS or chars + len(t or "") > _BATCH_CHARS):
            yield begin, texts
            texts, begin, chars = [], i, 0
        texts.append(t)
        chars += len(t or "")
    if texts:
        yield begin, texts


def encode_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of every row; an empty list for empty and null texts. Other columns are ignored.

    Rows that repeat come out once each; an empty table gives an empty result. Nothing is shuffled but an input with
    fewer partitions than cores.
    """
    rows = documents.select(documents[id_column].alias("doc_id"), documents[text_column].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for begin, texts in portions(batch, 1):
                ids = [encode(t) for t in texts]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(ids)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return spread(rows).mapInArrow(run, f"doc_id {kind}, ids array<int>")
