"""Cutting texts that are too long at natural boundaries (problem 9).

Sizes are in tokens of a public vocabulary. Every token of a long text is written as one letter that says what kind of
boundary its end is, so that a bounded quantifier over the letters counts tokens:

    P  paragraph (blank line), heading or end of a fenced block      L  line, and so row, log entry or chat turn
    S  sentence, in Latin, Japanese and Devanagari writing, or a record of a serialised list
    C  clause       W  word      c  any other whole character       x  inside a character (no cut is possible)

One regular expression with the alternatives in order of boundary strength, the bounded quantifier consuming up to the
limit, the character as the fallback, extracts the pieces; SQL array functions turn their lengths into token offsets and
look back by the overlap. A boundary in the second half of what a piece may hold comes before one in the first half, whatever
their kinds, so that pieces don't get short; a character is cut only where there is no boundary at all. Texts, letters and
character ends are arrays of blocks, so that a piece is cut out of the blocks that it touches: the work grows in
proportion to a text's length. Tokens never reach over pre-tokens and any stretch of whole tokens of a pre-token encodes to
itself, so a piece has as many tokens as letters (or fewer: blanks that end a piece may be merged, as no word follows that
takes the last of them), and pieces put end to end (less the overlap) are the text.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.tokens import KEPT, KEPT_LENGTH, VOCABULARY, encoder, portions
from detlake.session import spread

LIMIT, OVERLAP = 1024, 64
#: A character has four bytes and so four tokens at most: the overlap may begin up to three tokens earlier.
_SLACK = 3
#: Characters in a block of a text.
BLOCK = 4096

_SENTENCE = re.compile(r"[.!?…。！？．।॥]['\"”’»)\]）」』]*$")
_CLAUSE = re.compile(r"[,;:،、，；：—–]['\"”’)\]）」』]*$")
_WIDE = re.compile(r"[。！？．।॥、，；：」』）]")


def _kind(piece: str, after: str, tail: str, head: str) -> str:
    """Kind of the boundary behind a pre-token: ``after`` is the next pre-token, tail and head the text around."""
    if not after:
        return "P"
    if "\n" in piece:
        ends = tail.rstrip(" \t")
        return "P" if ends.endswith("\n\n") or ends.endswith("```\n") or re.match(r"[ \t]*(#{1,6} |```)", head) else "L"
    if after[0] == "\n":
        return "c"  # the line break belongs to what it ends
    space = after[0].isspace()
    if (space or _WIDE.search(piece[-1])) and _SENTENCE.search(piece):
        return "S"
    if "}," in piece or "],[" in piece:
        return "S"
    if (space or _WIDE.search(piece[-1])) and _CLAUSE.search(piece):
        return "C"
    return "W" if space else "c"


def _inside(piece: str, enc) -> tuple[str, tuple[int, ...]]:
    """Letters and character ends of a pre-token's tokens but for the letter of the last."""
    letters, ends, done, data = [], [], 0, piece.encode()
    if len(data) == len(piece):
        for t in enc.lookup(piece)[:-1]:
            done += len(enc.bytes[t])
            letters.append("c")
            ends.append(done)
    else:
        char = np.cumsum([(b & 0xC0) != 0x80 for b in data])  # characters begun up to each byte
        for t in enc.lookup(piece)[:-1]:
            done += len(enc.bytes[t])
            letters.append("c" if (data[done] & 0xC0) != 0x80 else "x")
            ends.append(int(char[done]) - 1)
    return "".join(letters), (*ends, len(piece))


class _Marks(dict):
    """(pre-token, first character of the next) -> letters and ends; pre-tokens with line breaks depend on more."""

    def __init__(self, enc):
        self.enc = enc

    def __missing__(self, key: tuple[str, str]):
        inner, ends = _inside(key[0], self.enc)
        found = (inner + _kind(*key, "", ""), ends)
        if len(key[0]) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[key] = found
        return found


_marks: dict[int, _Marks] = {}


def _letters(text: str, enc, least: int) -> tuple[str, np.ndarray] | None:
    """Letters and character ends of a text's tokens, None for a text of at most ``least`` tokens."""
    pieces = enc.pieces(text)
    if sum(map(len, map(enc.lookup, pieces))) <= least:
        return None
    marks = _marks.setdefault(id(enc), _Marks(enc))
    starts = np.r_[0, np.cumsum([len(p) for p in pieces])]
    found = []
    for i, key in enumerate(zip(pieces, [*(p[0] for p in pieces[1:]), ""])):
        if "\n" in key[0]:
            inner, ends = _inside(key[0], enc)
            at = int(starts[i + 1])
            found.append((inner + _kind(*key, text[max(0, at - 8) : at], text[at : at + 12]), ends))
        else:
            found.append(marks[key])
    flat = np.fromiter(chain.from_iterable(e for _, e in found), np.int64)
    begin = np.repeat(starts[:-1], [len(e) for _, e in found])
    return "".join(m for m, _ in found), (flat + begin).astype(np.int32)


def _pattern(limit: int, overlap: int) -> str:
    def one(most: int) -> str:
        low = most // 2
        strong = "|".join(f".{{{low},{most - 1}}}{kind}" for kind in "PLSCW")
        early = "|".join(f".{{0,{low - 1}}}{kind}" for kind in "PLSCW")
        return f".{{1,{most}}}\\z|{strong}|{early}|.{{0,{most - 1}}}[^x]"

    return f"\\A(?:{one(limit)})|(?:{one(limit - overlap - _SLACK)})"


def split_documents(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens: (doc_id, piece, tokens, begin, text).

    ``piece`` counts from 0, ``begin`` is the piece's first token in the text. No piece has more than ``limit`` tokens and
    consecutive pieces share ``overlap`` tokens (up to three more where that token lies inside a character). Shorter,
    empty and null texts give no row; rows that repeat come out once each. Other columns are ignored.
    """
    if limit < 2 * (overlap + _SLACK + 4):
        raise ValueError("the limit must be over twice the overlap")
    rows = documents.select(documents[id_column].alias("doc_id"), documents[text_column].alias("text")).where(F.octet_length("text") > limit)  # a token has a byte at least
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for begin, texts in portions(batch, 1):
                for i, text in enumerate(texts):
                    if text and (found := _letters(text, enc, limit)):
                        letters, ends = found
                        cut_up = lambda t: pa.array([[t[k : k + BLOCK] for k in range(0, len(t), BLOCK)]])
                        offsets = pa.array([0, len(ends)], pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(begin + i, 1), cut_up(text), pa.array([letters]), cut_up(letters), pa.ListArray.from_arrays(offsets, pa.array(ends))], names=["doc_id", "blocks", "letters", "letter_blocks", "ends"]
                        )

    long = spread(rows).mapInArrow(run, f"doc_id {kind}, blocks array<string>, letters string, letter_blocks array<string>, ends array<int>")
    sizes = F.transform(F.regexp_extract_all("letters", F.lit(_pattern(limit, overlap)), F.lit(0)), lambda s: F.length(s))
    stops = F.aggregate("sizes", F.array(F.lit(0)), lambda done, size: F.array_append(done, F.element_at(done, -1) + size))
    stopped = long.withColumn("sizes", sizes).select("doc_id", "blocks", "letter_blocks", "ends", stops.alias("stops"))

    def piece(stop, n):
        back = F.element_at("stops", n + 1) - F.lit(overlap)
        inside = F.length(F.regexp_extract(_stretch("letter_blocks", F.greatest(back - 3, F.lit(0)), F.greatest(back, F.lit(0))), "x*$", 0))
        begin = F.when(n == 0, F.lit(0)).otherwise(back - inside)
        return F.struct(n.alias("piece"), stop.alias("stop"), begin.alias("begin"))

    def written(p):
        first = F.when(p["begin"] == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest(p["begin"], F.lit(1))))
        return F.struct(p["piece"].alias("piece"), (p["stop"] - p["begin"]).alias("tokens"), p["begin"].alias("begin"), _stretch("blocks", first, F.element_at("ends", p["stop"])).alias("text"))

    # all pieces of a text are made in its own row: what is exploded carries the piece alone
    pieces = F.transform(F.transform(F.slice("stops", 2, F.size("stops") - 1), piece), written)
    return stopped.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.*")


def _stretch(blocks: str, begin, end):
    """Characters begin..end of a text in blocks, read from the blocks that they touch."""
    first = F.floor(begin / BLOCK).cast("int")
    touched = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(touched, begin - first * BLOCK + 1, end - begin)


def split_found(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id) of the texts that were cut: those with a second piece."""
    return split_documents(documents, limit=limit, overlap=overlap, vocabulary=vocabulary).where(F.col("piece") == 1).select("doc_id").distinct()
