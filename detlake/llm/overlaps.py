"""Same or nearly the same records across splits (problem 4).

The evaluation side is held in compressed full-text (FM) indexes, one a shard; the training side streams through them by
backward search. What is indexed are the distinct hash values of the evaluation records, written as strings of byte
symbols, and each search starts at a seed:

* an exact hash has one seed, its 64-bit digest; the hashes themselves are compared afterwards;
* a 64-bit perceptual hash within two bits of another agrees with it in at least two of four 16-bit words, so it has six
  seeds, one a pair of words. A seed's string holds the other two words, the two words of the seed and the seed's own
  closing symbol. Backward search reads closing symbol and seed first, which leaves exactly the evaluation hashes that
  share it. A seed that would compare more than HOT_PAIRS pairs of hashes of both sides (flat images) is refined: of the four
  other bytes at least two agree as well, so six longer seeds of 48 bits take its place, and one of those can't have more
  than 65,536 distinct hashes.

Records are sent to the shard of their seed, so training isn't replicated over shards, and a shard stays as small as its
share of seeds. Copies are collapsed to distinct values first: a hash that a third of all records share is one string.
Records that agree in everything (splits, countries, hashes) are one class with a count. Pairs of values become pairs of
classes, and the report multiplies the classes' counts instead of pairing their records; only the list of pairs spreads
them to records, as that is what it lists.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.session import cut, norm

#: Pairs of 16-bit words of a perceptual hash, most significant word first.
SEEDS = tuple(itertools.combinations(range(4), 2))
WORDS = tuple((a, b, *(w for w in range(4) if w not in (a, b))) for a, b in SEEDS)
MAX_BITS = 2
#: The exact hash's symbol; perceptual seeds have 1 to 6, refined ones 7 to 42.
EXACT = 0
HOT_PAIRS = 10_000_000
#: Every how many text positions the suffix array is kept.
SAMPLE = 4
#: Symbols of a shard's index at most; a longer shard gets several indexes, each of which every pattern passes.
INDEX_SYMBOLS = 4_000_000


class FullTextIndex:
    """Burrows-Wheeler index of an array of small symbols: sampled suffix array, and the places of each symbol.

    About seven bytes a symbol: two of the transform, four of its inverse, one of the samples and bits that mark them.
    Backward search is done for many patterns at once; every step is one array operation over those still alive.
    """

    def __init__(self, text: np.ndarray, alphabet: int):
        text = np.r_[text.astype(np.int64) + 1, 0]  # 0 ends the text and sorts first
        n = len(text)
        self.alphabet = alphabet + 1
        suffixes = _suffix_array(text)
        self.last = text[suffixes - 1].astype(np.int16)  # the transform; suffix 0 wraps to the end
        self.before = np.searchsorted(text[suffixes], np.arange(self.alphabet + 1))
        # occurrence counts as sorted positions a symbol: a rank is one binary search
        by_symbol = np.argsort(self.last, kind="stable")
        places = by_symbol.astype(np.int64) + self.last[by_symbol].astype(np.int64) * (n + 1)
        self.places = places.astype(np.int32) if self.alphabet * (n + 1) < 1 << 31 else places
        self.n = n
        kept = suffixes % SAMPLE == 0
        self.marks = np.packbits(kept, bitorder="little")
        self.marks = np.r_[self.marks, np.zeros(-len(self.marks) % 8 + 8, np.uint8)].view(np.uint64)
        self.marked_before = np.r_[0, np.cumsum(np.bitwise_count(self.marks))].astype(np.int32)
        self.samples = (suffixes[kept] // SAMPLE).astype(np.int32)

    def occurrences(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before a place."""
        return np.searchsorted(self.places, (upto + symbol * (self.n + 1)).astype(self.places.dtype)) - self.before[symbol]

    def marked(self, at: np.ndarray) -> np.ndarray:
        return (self.marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def marks_upto(self, at: np.ndarray) -> np.ndarray:
        below = self.marks[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.marked_before[at >> 6] + np.bitwise_count(below)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.before[symbol]
        return start + self.occurrences(symbol, low), start + self.occurrences(symbol, high)

    def search(self, patterns: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows of symbols) read from their end: suffix range after the seed, and length of the maximal match.

        The range is that of the last ``seed`` symbols, empty (low = high) where they don't occur; the length goes on
        beyond the seed as long as anything is left.
        """
        m, width = patterns.shape
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        at, length = np.arange(m), np.zeros(m, np.int64)
        out_low, out_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for k in range(width):
            low, high = self.step(patterns[at, width - 1 - k].astype(np.int64) + 1, low, high)
            alive = high > low
            at, low, high = at[alive], low[alive], high[alive]
            length[at] = k + 1
            if k + 1 == seed:
                out_low[at], out_high[at] = low, high
            if not len(at):
                break
        return out_low, out_high, length

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order."""
        places, steps, found = places.copy(), np.zeros(len(places), np.int64), np.empty(len(places), np.int64)
        open_ = np.arange(len(places))
        while len(open_):
            here = places[open_]
            hit = self.marked(here)
            done = open_[hit]
            found[done] = self.samples[self.marks_upto(places[done])].astype(np.int64) * SAMPLE + steps[done]
            open_ = open_[~hit]
            symbol = self.last[places[open_]].astype(np.int64)
            places[open_] = self.before[symbol] + self.occurrences(symbol, places[open_])
            steps[open_] += 1
        return found


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling, the first round on six packed symbols."""
    n, packed = len(text), np.zeros(len(text), np.int64)
    for k in range(6):
        packed = packed * 512 + np.r_[text[k:], np.zeros(min(k, n), np.int64)][:n]
    order = np.argsort(packed, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = packed[order]
    rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    width = 6
    while rank[order[-1]] < n - 1:
        after = np.r_[rank[width:] + 1, np.zeros(min(width, n), np.int64)][:n]
        tied = np.bincount(rank, minlength=n)[rank] > 1
        which = np.flatnonzero(tied)  # only suffixes that still tie move
        key = rank[which] * (n + 1) + after[which]
        local = np.argsort(key, kind="stable")
        places = _slots(rank, which)
        order[places] = which[local]
        ordered_key = np.full(n, -1, np.int64)
        ordered_key[places] = key[local]
        base = rank[order]
        new = np.r_[0, (base[1:] != base[:-1]) | (ordered_key[1:] != ordered_key[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
    return order


def _slots(rank: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places in the suffix order that belong to the tied suffixes."""
    starts = np.r_[0, np.bincount(rank).cumsum()][:-1]
    mine = np.sort(rank[which])
    first = np.r_[True, mine[1:] != mine[:-1]]
    within = np.arange(len(mine)) - np.maximum.accumulate(np.where(first, np.arange(len(mine)), 0))
    return starts[mine] + within


def _layouts() -> np.ndarray:
    """Order of a hash's bytes (most significant first) in the strings of each kind."""
    word = lambda w: (2 * w, 2 * w + 1)
    out = [tuple(range(8))]
    out += [(*word(c), *word(d), *word(a), *word(b)) for a, b, c, d in WORDS]
    for a, b, c, d in WORDS:
        other = (*word(c), *word(d))
        out += [(*(other[i] for i in range(4) if i not in (p, q)), *word(a), *word(b), other[p], other[q]) for p, q in SEEDS]
    return np.array(out)


LAYOUTS = _layouts()


def _strings(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Nine symbols a row: what isn't in the seed, the seed and the closing symbol 256 + kind."""
    parts = value.astype(">i8").view(np.uint8).reshape(-1, 8)
    out = np.empty((len(value), 9), np.int64)
    out[:, :8], out[:, 8] = np.take_along_axis(parts, LAYOUTS[kind], axis=1), 256 + kind
    return out


def _depth(kind: np.ndarray) -> np.ndarray:
    """Symbols that a search must match: all of an exact hash, four or six bytes of a perceptual one."""
    return np.where(kind == EXACT, 9, np.where(kind <= len(SEEDS), 5, 7))


def _first_kind(differ: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a pair's kind is the first that it agrees in (pairs agree in several; one reports them)."""
    same = differ.astype(">u8").view(np.uint8).reshape(-1, 8) == 0
    words = same[:, 0::2] & same[:, 1::2]
    first = np.argmax(np.stack([words[:, a] & words[:, b] for a, b in SEEDS], axis=1), axis=1)
    fine = kind > len(SEEDS)
    ok = np.where(fine, (kind - 1 - len(SEEDS)) // len(SEEDS), kind - 1) == first
    if fine.any():
        rest = np.take_along_axis(same, LAYOUTS[first + 1][:, :4], axis=1)
        sub = np.argmax(np.stack([rest[:, p] & rest[:, q] for p, q in SEEDS], axis=1), axis=1)
        ok &= ~fine | ((kind - 1 - len(SEEDS)) % len(SEEDS) == sub)
    return ok


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64))


def _unfold(who: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 1_000_000):
    """(who, place) of all places in the ranges, in pieces of bounded size."""
    many = high - low
    ends = np.cumsum(many)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, most):
        at = np.arange(begin, min(begin + most, int(ends[-1])))
        row = np.searchsorted(ends, at, side="right")
        yield who[row], low[row] + at - (ends[row] - many[row])


def _shard(batches, max_bits: int, index_symbols: int):
    """Rows of one shard, evaluation first: (train, kind, value) -> pairs (kind, train_value, eval_value)."""
    kinds: list[np.ndarray] = []
    values: list[np.ndarray] = []
    indexes: list[tuple[FullTextIndex, np.ndarray]] | None = None

    def build():
        kind, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kinds, values))
        rows = max(1, index_symbols // 9)
        return [(FullTextIndex(_strings(kind[i : i + rows], value[i : i + rows]).ravel(), 256 + len(LAYOUTS)), value[i : i + rows]) for i in range(0, len(kind), rows)]

    for batch in batches:
        train, kind, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if (~train).any():
            kinds.append(kind[~train].astype(np.int64))
            values.append(value[~train])
        if not train.any():
            continue
        if indexes is None:
            indexes = build()
        kind, value = kind[train].astype(np.int64), value[train]
        patterns = _strings(kind, value)
        for index, there in indexes:
            depth = _depth(kind)
            for need in np.unique(depth):
                mine = np.flatnonzero(depth == need)
                low, high, _ = index.search(patterns[mine], int(need))
                hit = high > low
                for who, places in _unfold(mine[hit], low[hit], high[hit]):
                    other = there[index.locate(places) // 9]
                    if need < 9:
                        differ = value[who].view(np.uint64) ^ other.view(np.uint64)
                        ok = np.flatnonzero(_bits(differ) <= max_bits)
                        ok = ok[_first_kind(differ[ok], kind[who[ok]])]
                        who, other = who[ok], other[ok]
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(kind[who].astype(np.int32)), pa.array(value[who]), pa.array(other)], names=["kind", "train_value", "eval_value"])


def _searched(values: DataFrame, max_bits: int) -> DataFrame:
    """values (train, kind, value, seed): pairs of values across the splits."""
    laid = values.repartition("kind", "seed").drop("seed").sortWithinPartitions("train")
    return laid.mapInArrow(lambda batches: _shard(batches, max_bits, INDEX_SYMBOLS), "kind int, train_value long, eval_value long")


def split_side(column):
    """True for train, False for val (or validation) and test, null otherwise; spelling doesn't matter."""
    s = norm(column)
    return F.when(s == "train", F.lit(True)).when(s.isin("val", "validation", "test"), F.lit(False))


def dhash_value(column):
    """A hexadecimal 64-bit number in any spelling (case, blanks, 0x, no leading zeros) as a signed long, else null.

    All zero and all one bits are no evidence and null as well.
    """
    digits = F.regexp_replace(norm(column), "^0x", "")
    value = F.when(digits.rlike("^0*[0-9a-f]{1,16}$"), F.conv(digits, 16, -10).cast("long"))
    return F.when(~value.isin(0, -1), value)


def records(images: DataFrame, entries: DataFrame) -> DataFrame:
    """Exported images: (id, train, split, country, sha, dhash), as often as the tables repeat them; both tables must know the image."""
    image = images.where(F.col("canonical_image_id").isNotNull()).select(
        F.col("canonical_image_id").alias("id"), "country", norm("image_sha256").alias("sha"), dhash_value(F.col("perceptual_hash_dhash64")).alias("dhash")
    )
    entry = entries.select(F.col("canonical_image_id").alias("id"), split_side(F.col("split")).alias("train"), F.when(norm("split") == "validation", "val").otherwise(norm("split")).alias("split")).where(F.col("train").isNotNull())
    return image.where("coalesce(sha, '') <> '' OR dhash IS NOT NULL").join(entry, "id")


def value_pairs(rec: DataFrame, max_bits: int = MAX_BITS, hot_pairs: int | None = None) -> DataFrame:
    """Pairs of distinct hash values across train and evaluation: (kind 0 exact, else perceptual; train_value, eval_value)."""
    hot_pairs = HOT_PAIRS if hot_pairs is None else hot_pairs
    if not 0 <= max_bits <= 2:
        raise ValueError("two words of four agree only up to two differing bits")
    exact = rec.where("coalesce(sha, '') <> ''").select("train", F.lit(EXACT).alias("kind"), F.xxhash64("sha").alias("value")).distinct().withColumn("seed", F.col("value"))
    near = rec.where("dhash IS NOT NULL").select("train", F.col("dhash").alias("value")).distinct()
    word = lambda w: F.shiftrightunsigned("value", 48 - 16 * w).bitwiseAND(F.lit(0xFFFF))
    two = lambda a, b: F.shiftleft(word(a), 16).bitwiseOR(word(b))
    seeds = F.array(*(F.struct(F.lit(k + 1).alias("kind"), two(a, b).alias("seed"), two(c, d).alias("rest")) for k, (a, b, c, d) in enumerate(WORDS)))
    near = near.select("train", "value", F.explode(seeds).alias("s")).select("train", "s.kind", "value", "s.seed", "s.rest")
    sides = near.groupBy("kind", "seed").agg(F.count_if("train").alias("_t"), F.count_if(~F.col("train")).alias("_e"))
    hot = sides.where(F.col("_t").cast("double") * F.col("_e") > hot_pairs).select("kind", "seed", F.lit(True).alias("_hot"))
    byte = lambda i: F.shiftrightunsigned("rest", 24 - 8 * i).bitwiseAND(F.lit(0xFF))
    fine = F.array(*(F.struct((F.lit(len(SEEDS) + 1 + j) + (F.col("kind") - 1) * len(SEEDS)).alias("kind"), F.shiftleft("seed", 16).bitwiseOR(F.shiftleft(byte(p), 8)).bitwiseOR(byte(q)).alias("seed")) for j, (p, q) in enumerate(SEEDS)))
    own = F.array(F.struct(F.col("kind"), F.col("seed")))
    near = near.join(hot, ["kind", "seed"], "left").select("train", "value", F.explode(F.when(F.col("_hot"), fine).otherwise(own)).alias("s")).select("train", "s.kind", "value", "s.seed")
    return _searched(exact.select("train", "kind", "value", "seed").unionByName(near), max_bits)


def classes(rec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records by what they hold: (class, n, train, split, country, sha, dhash) a row a record of a class, and (class, id).

    Ids whose records agree in every column are one class, named by its least id; n is how many they are. What an id holds
    is compared by 128 bits of hash.
    """
    held = F.array_sort(F.collect_set(F.struct("train", "split", "country", "sha", "dhash"))).alias("held")
    members = cut(rec.groupBy("id").agg(held).select("id", "held", F.xxhash64("held").alias("_1"), F.xxhash64(F.lit(1), "held").alias("_2")))
    named = cut(members.groupBy("_1", "_2").agg(F.min(F.struct("id", "held")).alias("m"), F.count("*").alias("n")))
    of = named.select(F.col("m.id").alias("class"), "n", F.explode("m.held").alias("h")).select("class", "n", "h.*")
    return of, members.select("id", "_1", "_2").join(named.select(F.col("m.id").alias("class"), "_1", "_2"), ["_1", "_2"]).select("class", "id")


def class_pairs(of: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(train_class, train_n, eval_class, eval_n, split, country, exact): classes of different sides that are the same or nearly."""
    found = cut(value_pairs(of.withColumnRenamed("class", "id"), max_bits))
    key = F.xxhash64("sha")
    train, held = of.where("train"), of.where("NOT train")
    t = lambda value: train.select(value.alias("train_value"), F.col("class").alias("train_class"), F.col("n").alias("train_n"), F.col("sha").alias("_ts")).distinct()
    e = lambda value: held.select(value.alias("eval_value"), F.col("class").alias("eval_class"), F.col("n").alias("eval_n"), "split", "country", F.col("sha").alias("_es")).distinct()
    exact = found.where(F.col("kind") == EXACT).join(t(key), "train_value").join(e(key), "eval_value").where("_ts = _es")
    near = found.where(F.col("kind") > EXACT).join(t(F.col("dhash")), "train_value").join(e(F.col("dhash")), "eval_value")
    both = exact.withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False)))
    # a class that stands on both sides pairs its records with each other, so one record alone has none
    both = both.where("train_class <> eval_class OR eval_n > 1")
    return both.groupBy("train_class", "train_n", "eval_class", "eval_n", "split", "country").agg(F.bool_or("exact").alias("exact"))


def found_pairs(images: DataFrame, entries: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(first_image_id, second_image_id): pairs of images of different sides that are the same or nearly, each once.

    Null, blank and contentless hashes match nothing, unknown splits take no part, an image that stands on both sides
    isn't paired with itself. A repeated record changes nothing; an image with several hashes matches by any of them.
    """
    of, members = classes(records(images, entries))
    pairs = class_pairs(of, max_bits).select(F.least("train_class", "eval_class").alias("a"), F.greatest("train_class", "eval_class").alias("b")).distinct()
    side = lambda c, i: members.select(F.col("class").alias(c), F.col("id").alias(i))
    ids = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where("x <> y")
    # two different classes meet once, so only a class with itself gives a pair in both orders
    return ids.where("a <> b OR x < y").select(F.least("x", "y").alias("first_image_id"), F.greatest("x", "y").alias("second_image_id"))


def report(images: DataFrame, entries: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Per evaluation split and country: evaluation images that overlap train, exactly and at all, and pairs.

    Counts are products and sums of the classes' counts; no record is paired with another for them.
    """
    pairs = class_pairs(classes(records(images, entries))[0], max_bits)
    n = F.col("train_n") * F.col("eval_n") - F.when(F.col("train_class") == F.col("eval_class"), F.col("eval_n")).otherwise(0)
    each = pairs.groupBy("split", "country", "eval_class").agg(F.max("eval_n").alias("m"), F.sum(n).alias("pairs"), F.bool_or("exact").alias("exact"))
    return each.groupBy("split", "country").agg(F.sum("m").alias("images"), F.sum(F.when(F.col("exact"), F.col("m")).otherwise(0)).alias("exact_images"), F.sum("pairs").alias("pairs"))
