"""Evaluation texts that leak into training text (problem 8), by winnowing.

Texts become words (longest runs of letters and digits after NFKC and lower-casing) and words become 64-bit numbers. For a
span of s shared words, k-gram hashes are taken for a fixed k, and of every s - k + 1 consecutive ones the least is a
fingerprint: any span of s equal words contains a whole window, whose least hash is the same on both sides, so no such span
is missed. The fingerprints of both sides are joined, and each hit is extended in both directions by comparing the words
around it; an extension that is long enough is a leak.

Items of at least SPAN words need SPAN shared words; a shorter item needs all of its words, so each length below SPAN is a
family with its own k and window.

Scale. The corpus is read once, whatever the number of items. A bit map of fixed size (FILTER_BITS) of the items'
fingerprints goes to the workers, so that corpus fingerprints that no item has aren't shuffled; when very many items fill
the map more of them pass, and the join alone decides. A fingerprint carries the words that its extension can need (at most
SPAN on one side and SPAN - k on the other), so no text is read again. Equal surroundings in many documents are joined with
the items once and spread to the documents afterwards, so a passage that a third of all documents hold is one row of the join.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.llm.tokens import portions
from detlake.session import cut, spread

SPAN, GRAM = 12, 6
#: Size of the bit map of fingerprints, as a power of two: 8 MB.
FILTER_BITS = 26
_WORD = re.compile(r"[^\W_]+").findall
#: Scripts written without blanks (Thai, Lao, Myanmar, Khmer, kana, Han): with ``scripts`` each of their characters is a word.
_DENSE = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
_WORD_OR_CHARACTER = re.compile(rf"[{_DENSE}]|[^\W_{_DENSE}]+").findall
_FACTOR = 0x9E3779B97F4A7C15


def words_of(text: str | None, scripts: bool = False) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return _WORD(text.lower())
    return (_WORD_OR_CHARACTER if scripts else _WORD)(unicodedata.normalize("NFKC", text).lower())


class _Numbers(dict):
    """Words as 64-bit numbers; bounded, as it is only a memory of a pure function."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_numbers = _Numbers()


def number(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))


def grams(numbers: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_FACTOR) + numbers[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least hash of each window."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, window):
        np.minimum(out, hashes[j : j + n], out=out)
    return out


def plan(need: int) -> tuple[int, int]:
    """(k, window) of the family whose items need so many shared words."""
    k = GRAM if need == SPAN else min(4, need)
    return k, need - k + 1


def _places(hashes: np.ndarray, need, bits: int) -> np.ndarray:
    """Bits of families' fingerprints in the map."""
    return ((hashes ^ np.asarray(need, np.uint64)) * np.uint64(_FACTOR)) >> np.uint64(64 - bits)


def _prints(numbers: np.ndarray, text: np.ndarray, need: int, hashed: dict[int, np.ndarray], passes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a family's fingerprints in the words of several texts, one after the other.

    ``text`` says which text a word belongs to. All places of a gram that is the least of some window count.
    """
    k, window = plan(need)
    if len(numbers) < need:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if k not in hashed:
        hashed[k] = grams(numbers, k)
    h = hashed[k]
    least = winnow(h, window)[text[: len(text) - need + 1] == text[need - 1 :]]
    if passes is not None:
        least = least[passes(least, need)]
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.unique(least)
    at = np.searchsorted(least, h)
    own = np.flatnonzero((least[np.minimum(at, len(least) - 1)] == h) & (text[: len(h)] == text[k - 1 :]))
    return own, h[own]


_CONTEXT = "need int, print long, before array<string>, words array<string>"


def _contexts(rows: DataFrame, scripts: bool, needs: tuple[int, ...] | None, sent, extra: str, filter_bits: int) -> DataFrame:
    """rows (id, text) -> (id, need, print, before, words, at): fingerprints with the words that an extension can need.

    ``before`` is read backwards from the gram, ``words`` begins with it. Without ``needs`` each text is an item and has the
    family of its own length, else all families are taken and filtered through the map.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        passes = None
        if sent is not None:
            bits = sent.value

            def passes(hashes, need):
                place = _places(hashes, need, filter_bits)
                return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            for begin, texts in portions(batch, 1):
                split = [words_of(t, scripts) for t in texts]
                sizes = np.array([len(w) for w in split])
                starts = np.r_[0, np.cumsum(sizes)]
                flat = [w for words in split for w in words]
                numbers, text = number(flat), np.repeat(np.arange(len(split)), sizes)
                own_need, hashed, out = np.minimum(sizes, SPAN), {}, []
                for need in needs if needs is not None else sorted(set(own_need[own_need > 0].tolist())):
                    k, _ = plan(need)
                    at, hashes = _prints(numbers, text, need, hashed, passes)
                    if needs is None:
                        mine = own_need[text[at]] == need
                        at, hashes = at[mine], hashes[mine]
                    for a, h in zip(at.tolist(), hashes.tolist()):
                        t = int(text[a])
                        low, high = int(starts[t]), int(starts[t + 1])
                        out.append((t, need, h, flat[max(low, a - need + k) : a][::-1], flat[a : min(high, a + need)], a - low))
                for part in range(0, len(out), 10_000):
                    rows_, need_, h_, before, words, at_ = zip(*out[part : part + 10_000])
                    hashes = np.array(h_, np.uint64)
                    place = _places(hashes, need_, filter_bits)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([begin + r for r in rows_])), pa.array(need_, pa.int32()), pa.array(hashes.view(np.int64)), pa.array(before, pa.list_(pa.string())), pa.array(words, pa.list_(pa.string())), pa.array(at_, pa.int32()), pa.array(place.astype(np.int64))],
                        names=["id", "need", "print", "before", "words", "at", "place"],
                    )

    return rows.mapInArrow(run, f"id {kind}, {_CONTEXT}, at int, place long").select("id", "need", "print", "before", "words", *extra.split())


def _map_of(items: DataFrame, filter_bits: int) -> np.ndarray:
    """The bit map of the items' fingerprints: at most 2^filter_bits bits leave the cluster, however many items there are."""
    word = F.expr("shiftright(place, 6)").alias("word")
    found = items.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (filter_bits - 6), np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def _common(a: str, b: str):
    """Length of the common beginning of two arrays."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first == 0, F.size(a)).otherwise(first - 1)


def _sides(documents: DataFrame, items: DataFrame, scripts: bool, at: str, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints with contexts of documents (those that pass the map) and items."""
    item = cut(_contexts(spread(items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("id"), "text")), scripts, None, None, "at place", filter_bits))
    needs = tuple(sorted(r[0] for r in item.select("need").distinct().collect()))  # at most SPAN
    sent = documents.sparkSession.sparkContext.broadcast(_map_of(item, filter_bits))
    rows = spread(documents.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text"))
    hits = cut(_contexts(rows, scripts, needs, sent, at, filter_bits).distinct())
    sent.unpersist()
    return hits.withColumnRenamed("id", "doc_id"), item.drop("place").withColumnsRenamed({"id": "item_id", "before": "_before", "words": "_words", "at": "item_at"})


def _extended(hits: DataFrame, item: DataFrame) -> DataFrame:
    """Different surroundings in documents joined with those of the items and extended: (..., item_id, item_at, left, right)."""
    around = hits.select("need", "print", "before", "words").distinct()
    return around.join(item, ["need", "print"]).withColumn("left", _common("before", "_before")).withColumn("right", _common("words", "_words")).drop("_before", "_words")


def leaked(documents: DataFrame, items: DataFrame, scripts: bool = False, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id), distinct: documents that hold SPAN consecutive words of an item, or all words of a shorter one.

    Null, empty and wordless texts on either side match nothing, and items without an id are left out. With ``scripts`` each
    character of a script without blanks is a word, else a run of them is one. Repeated rows and other columns change nothing.
    """
    hits, item = _sides(documents, items, scripts, "", filter_bits)
    found = _extended(hits, item.drop("item_at").distinct()).where("left + right >= need").select("need", "print", "before", "words", "item_id").distinct()
    return hits.join(found, ["need", "print", "before", "words"]).select("doc_id", "item_id").distinct()


def spans(documents: DataFrame, items: DataFrame, scripts: bool = True, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, doc_begin, item_begin, words): every maximal passage that leaked, in words counted from 0.

    Extensions of neighbouring fingerprints overlap on the diagonal that they share and are put together there. Scripts
    without blanks are compared by characters unless ``scripts`` is false.
    """
    hits, item = _sides(documents, items, scripts, "at", filter_bits)
    found = _extended(hits, item.distinct()).where("left + right >= need")
    each = hits.join(found, ["need", "print", "before", "words"]).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), (F.col("at") - F.col("left")).alias("begin"), (F.col("at") + F.col("right")).alias("end")).distinct()
    line = W.partitionBy("doc_id", "item_id", "diagonal").orderBy("begin", "end")
    reach = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    begun = each.withColumn("new", F.coalesce((F.col("begin") > reach).cast("int"), F.lit(1))).withColumn("n", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    whole = begun.groupBy("doc_id", "item_id", "diagonal", "n").agg(F.min("begin").alias("doc_begin"), F.max("end").alias("end"))
    return whole.select("doc_id", "item_id", "doc_begin", (F.col("doc_begin") - F.col("diagonal")).alias("item_begin"), (F.col("end") - F.col("doc_begin")).alias("words"))
