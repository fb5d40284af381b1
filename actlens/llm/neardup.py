"""Near-duplicate records by covering anchors, without loss.

A record is the set of its word runs. All elements have one global order, rare words first, and a record's fingerprint is the first
p = k + SPARE elements of its set in that order, where k is how many of its elements may be missing from a partner of similarity t
(k = n - ceil(t n)). The anchors are the words of a maximum-distance-separable code on those p places: its covering radius is p - 1, every
single element names an anchor, and a record is replicated to all of them. Two records of similarity t differ in at most k places of their
fingerprints, so they share at least SPARE anchors: no pair is lost. Elements found in one record only need no anchor, and a record with
fewer than SPARE shared elements has no partner. Anchors that too many records share are not capped but replaced by the next code's, which
take ``subset`` elements each (radius p - subset). Records that meet at an anchor are compared on their sizes and on parity bitmaps of their sets,
whose differing bits never exceed the sets' difference; what is left is compared exactly on the texts.

Binary fingerprints with Hamming-ball anchors were rejected: at similarity 0.6 one bit of a sketch agrees with
probability 0.8, so a ball that keeps 99 % of the pairs of a 23-bit Golay code holds hundreds of anchors for each record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.session import cut_lineage, ship, stored

WORD = r"[\p{L}\p{Nd}]+"
#: A word is common if this share of the records holds it; there are at most (mean distinct words) / share of them, a table of 16 bytes each.
COMMON_SHARE = 0.002
#: Common words up to which the table is sent to the executors; beyond it the share is raised until it fits (the order may be any, the result is the same).
COMMON_ROWS = 200_000
#: Elements that every pair shares in its fingerprints, for words and for longer runs.
SPARE = {1: 4}
SPARE_RUNS = 8
#: Longs of a record's parity bitmap by the words in a run: sets of single words are small.
BITMAP_LONGS = {1: 2}
BITMAP_LONGS_RUNS = 5
#: Records of one anchor up to which its pairs are compared directly; a larger one is replaced by anchors of two elements.
ANCHOR_RECORDS = 60
#: An element is hot if its rarest word is in this share of the records; its rows are spread over so many parts.
HOT_SHARE, HOT_PARTS = 0.05, 256
#: Ids (8 bytes each) up to which a set of them is sent to every executor instead of moving the texts.
SENT_IDS = 200_000
#: Unless every pair is asked for, classes of equal sets up to this size are listed as all their pairs; a larger one as each member with the smallest.
CLASS_PAIRS = 100

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_ROTATE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters hashed at a time.
CHUNK = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MULTIPLY
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points belong to words, and the powers of the hash's base and of its inverse modulo 2^64."""
    inside = np.zeros(0x110000, bool)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for m in regex.finditer(WORD, every):
        inside[m.start() : m.end()] = True
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    power = lambda x: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(CHUNK, x, np.uint64))))
    return inside, power(np.uint64(base)), power(np.uint64(inverse))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its words, lower-cased, in order; many texts are hashed together by prefix sums of one polynomial."""
    out: list[np.ndarray] = []
    held: list[str] = []
    size = 0
    for text in texts:
        low = text.lower()
        if size + len(low) >= CHUNK and held:
            out += _hashed(held)
            held, size = [], 0
        held.append(low)
        size += len(low) + 1
    return out + (_hashed(held) if held else [])


def _hashed(lowered: list[str]) -> list[np.ndarray]:
    inside, power, back = _tables()
    codes = np.frombuffer(" ".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) > CHUNK:  # one very long text
        power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(codes), power[1], np.uint64))))
        back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(codes), back[1], np.uint64))))
    word = inside[codes]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint32(1)).astype(np.uint64) * power[: len(codes)], dtype=np.uint64)))
    h = _mix((prefix[end] - prefix[begin]) * back[begin] + (end - begin).astype(np.uint64))
    starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    return np.split(h, np.searchsorted(begin, starts[1:-1]))


def element_hashes(w: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``run`` words, ascending, and where each first begins."""
    if len(w) < run:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w[: len(w) - run + 1]
    for i in range(1, run):
        h = _mix(h * _ROTATE + w[i : len(w) - run + 1 + i])
    return np.unique(h, return_index=True)


def _similar(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _allowed(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9)


def _bitmap(h: np.ndarray, longs: int) -> np.ndarray:
    """Parity of the number of elements on each of 64 * longs bits."""
    odd = np.bincount((h % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


PROFILE = "word boolean, id bigint, n bigint, h bigint, g bigint, bits array<bigint>"


def _profile(rows: DataFrame, run: int, min_size: int, longs: int) -> DataFrame:
    """One pass over the texts: a row per record of enough elements (id, size, 128-bit hash of the set, bitmap), and counted rows per word (hash, records of the batch)."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ident, size, first, second, bits, seen = [], [], [], [], [], []
            for key, w in zip(batch.column("_id").to_pylist(), word_hashes(batch.column("_text").to_pylist()), strict=True):
                h, _ = element_hashes(w, run)
                seen.append(h if run == 1 else np.unique(w))
                if len(h) >= min_size:
                    ident.append(key)
                    size.append(len(h))
                    d = xxhash.xxh128_intdigest(h.tobytes())
                    first.append((d >> 64) - (1 << 63))
                    second.append((d & ((1 << 64) - 1)) - (1 << 63))
                    bits.append(_bitmap(h, longs))
            words, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            m = len(words)
            flat = np.concatenate([np.zeros(0, np.int64), *bits])
            offsets = np.concatenate((np.arange(len(bits) + 1) * longs, np.full(m, len(bits) * longs))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(ident) + m) >= len(ident)),
                    pa.array(np.concatenate((np.array(ident, np.int64), words.view(np.int64)))),
                    pa.array(np.concatenate((np.array(size, np.int64), counts))),
                    pa.array(np.concatenate((np.array(first, np.int64), np.zeros(m, np.int64)))),
                    pa.array(np.concatenate((np.array(second, np.int64), np.zeros(m, np.int64)))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["word", "id", "n", "h", "g", "bits"],
            )

    return stored(rows.mapInArrow(profile, PROFILE))


def _common_words(profile: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common words and the number of records of each, from counts over all records (combined in each batch, then map-side)."""
    counts = profile.where("word").groupBy("id").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= max(2, COMMON_SHARE * total)))
    least, share = 0, COMMON_SHARE
    while counts.where(F.col("n") >= least).count() > COMMON_ROWS:
        share *= 2
        least = share * total
    table = {r["id"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in counts.where(F.col("n") >= least).toLocalIterator()}
    known = np.array(sorted(table), np.uint64)
    return known, np.array([table[k] for k in known.tolist()], np.int64)


def _sent(ids: DataFrame) -> DataFrame:
    """Ids sent to every executor if they are few enough, else as they are."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def similar_pairs(df: DataFrame, id_col: str, text_col: str, *, run: int, threshold: float, min_size: int, subset: int = 2, every: bool = False) -> DataFrame:
    """(``id_a``, ``id_b``, ``similarity``), id_a < id_b: all pairs of records whose sets of ``run`` successive words have a Jaccard similarity of at least ``threshold``.

    Words are maximal runs of letters and digits, lower-cased; texts are used whole. Null texts and texts with fewer than ``min_size`` distinct elements
    are in no pair. Records with equal sets are one class: with ``every`` all its pairs come out, and it is paired member by member with similar classes.
    Without, this holds up to ``CLASS_PAIRS`` records; a larger class comes out as each member with its smallest, which alone stands for it in pairs with other classes. Rows
    that repeat an id count once per id pair; an empty table gives no rows. ``subset`` is the number of elements of the anchors that replace crowded ones.
    """
    ship(df.sparkSession)
    longs = BITMAP_LONGS.get(run, BITMAP_LONGS_RUNS)
    base = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    profile = _profile(base, run, min_size, longs)
    total = profile.where(~F.col("word")).count()
    hot_records = max(ANCHOR_RECORDS + 1, HOT_SHARE * total)
    held = df.sparkSession.sparkContext.broadcast(_common_words(profile, total))

    def frequency(words: np.ndarray) -> np.ndarray:
        known, counts = held.value
        if not len(known):
            return np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        return np.where(known[at] == words, counts[at], 0)

    members = profile.where(~F.col("word")).select(F.col("id").alias("_id"), F.col("n").cast("int").alias("size"), "h", "g", "bits")
    heads = members.groupBy("h", "g", "size").agg(F.min("_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    grouped = stored(members.join(heads, ["h", "g", "size"]).select("_id", "head", "copies", "size", "bits"))
    alone = grouped.where(F.col("_id") == F.col("head")).select("_id", "size", "bits")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, owner, hot = [], [], []
            for ident, w in zip(batch.column("_id").to_pylist(), word_hashes(batch.column("_text").to_pylist()), strict=True):
                h, first = element_hashes(w, run)
                f = frequency(w)
                # an element is as rare as its rarest word; ties by hash
                rare = reduce(np.minimum, [f[i : len(w) - run + 1 + i] for i in range(run)])[first] if len(h) else f[:0]
                order = np.argsort(rare, kind="stable")[: _allowed(len(h), threshold) + spare]
                key.append(h[order].view(np.int64))
                owner.append(np.full(len(order), ident, np.int64))
                hot.append(np.where(rare[order] >= hot_records, rare[order], 0))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, owner, hot)], names=["key", "_id", "hot"])

    spare = min(SPARE.get(run, SPARE_RUNS), math.ceil(threshold * min_size - 1e-9))
    # copies take no part; their ids are few or the records are picked by a join
    copies = grouped.where(F.col("_id") != F.col("head")).select("_id")
    marked = base.join(_sent(copies), "_id", "left_anti").mapInArrow(anchors, "key bigint, _id bigint, hot bigint")
    # Elements whose words are all in many records aren't counted but taken as crowded, with their rarest word's count, and spread: no task gets all rows of one.
    salt = F.when(F.col("hot") > 0, F.pmod(F.xxhash64("_id"), F.lit(HOT_PARTS))).otherwise(F.lit(0))
    counted = marked.withColumn("_salt", salt).withColumn("n", F.greatest("hot", F.count(F.lit(1)).over(Window.partitionBy("key", "_salt")))).where(F.col("n") > 1)
    mine = Window.partitionBy("_id")
    known = counted.withColumn("_m", F.count(F.lit(1)).over(mine)).withColumn("_c", F.count(F.when(F.col("n") > ANCHOR_RECORDS, 1)).over(mine)).where(F.col("_m") >= spare)
    shared = stored(known.join(alone, "_id").select("key", "_id", "size", "n", F.col("_c").cast("int").alias("crowd"), *(F.col("bits")[i].alias(f"b{i}") for i in range(longs))))
    bits, taken = [f"b{i}" for i in range(longs)], min(subset, spare)
    direct = shared.where(F.col("n") <= ANCHOR_RECORDS).select("key", "_id", "size", "crowd", *bits)
    crowded = shared.where((F.col("n") > ANCHOR_RECORDS) & (F.col("crowd") >= spare)).groupBy("_id", "size", "crowd", *bits).agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("_all"))
    # of the spare elements that two records share, the rarest ``taken`` are never among the last of either
    crowded = crowded.withColumn("_keys", F.expr(f"transform(slice(_all, 1, size(_all) - {spare - taken}), x -> x.key)"))
    chosen = "transform(_keys, (x, i) -> named_struct('at', i, 'h', x))"
    for _ in range(taken - 1):
        chosen = f"flatten(transform({chosen}, c -> transform(slice(_keys, c.at + 2, size(_keys)), (x, i) -> named_struct('at', c.at + 1 + i, 'h', xxhash64(c.h, x)))))"
    replaced = crowded.select(F.explode(F.expr(f"transform({chosen}, c -> c.h)")).alias("key"), "_id", "size", "crowd", *bits)
    allowed = (1 - threshold) / (1 + threshold)

    def compare(rows: DataFrame, *weights: int) -> DataFrame:
        other = rows.select("key", F.col("_id").alias("b"), F.col("size").alias("size_b"), F.col("crowd").alias("crowd_b"), *(F.col(x).alias(f"o{x}") for x in bits))
        near = (F.col("_id") < F.col("b")) & (F.least("size", "size_b") >= F.greatest("size", "size_b") * F.lit(threshold) - F.lit(1e-9))
        differ = reduce(lambda a, c: a + c, [F.bit_count(F.col(x).bitwiseXOR(F.col(f"o{x}"))) for x in bits])
        near &= differ <= F.floor((F.col("size") + F.col("size_b")) * F.lit(allowed) + F.lit(1e-9))
        return rows.join(other, "key").where(near).select(F.col("_id").alias("a"), "b", "size", "size_b", F.least("crowd", "crowd_b").alias("crowd"), F.lit(weights[0]).alias("single"), F.lit(weights[1]).alias("several"))

    # The common elements up to the end of the fingerprint that ends first lie in both; the others lie beyond it. So the fingerprints must share
    # what a similarity of t needs beyond the longer rest. Crowded elements are counted from the subsets of them that the two share.
    met = compare(direct, 1, 0).unionByName(compare(replaced, 0, 1)).groupBy("a", "b", "size", "size_b").agg(F.max("crowd").alias("crowd"), F.sum("single").alias("single"), F.sum("several").alias("several"))
    if taken == 2:  # the largest c with comb(c, 2) <= several
        by_subsets = F.lit(spare - 2) + F.floor((F.lit(1) + F.sqrt(F.lit(1) + F.lit(8) * F.col("several"))) / 2)
    else:  # beyond the table the subsets give no bound
        whole = F.array(*(F.lit(math.comb(c, taken)) for c in range(taken, 150)))
        by_subsets = F.when(F.col("several") < math.comb(149, taken), F.lit(spare - 1) + F.size(F.filter(whole, lambda x: x <= F.col("several"))))
    crowd = F.when(F.col("crowd") < spare, F.col("crowd")).otherwise(F.least("crowd", by_subsets))
    rest = lambda n: n - (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + F.lit(spare))
    needed = F.ceil((F.col("size") + F.col("size_b")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)) - F.greatest(rest(F.col("size")), rest(F.col("size_b")))
    candidates = stored(met.where(F.col("single") + crowd >= needed).select("a", "b"))
    wanted = candidates.select(F.col("a").alias("_id")).unionAll(candidates.select("b")).distinct()
    texts = base.join(_sent(wanted), "_id", "left_semi")
    left = candidates.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a").join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, value = [], []
            for k, (x, y) in enumerate(zip(*(word_hashes(batch.column(c).to_pylist()) for c in ("_ta", "_tb")), strict=True)):
                s = _similar(element_hashes(x, run)[0], element_hashes(y, run)[0])
                if s >= threshold - 1e-12:
                    kept.append(k)
                    value.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(kept, pa.int64())), batch.column("b").take(pa.array(kept, pa.int64())), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    linked = left.select("a", "b", "_ta", "_tb").mapInArrow(verify, "a bigint, b bigint, similarity double")
    # only records with copies are looked up; unless every pair is asked for, a class of many copies stands for itself by its smallest
    large = F.lit(False) if every else F.col("copies") > CLASS_PAIRS
    several = grouped.where((F.col("copies") > 1) & ~large).select("head", "_id")
    several = _sent(several)
    ma, mb = several.select(F.col("head").alias("a"), F.col("_id").alias("x")), several.select(F.col("head").alias("b"), F.col("_id").alias("y"))
    across = linked.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "similarity")
    inside = several.select("head", F.col("_id").alias("x")).join(several.select("head", F.col("_id").alias("y")), "head").where(F.col("x") < F.col("y")).select("x", "y", F.lit(1.0).alias("similarity"))
    spread = grouped.where(large & (F.col("_id") != F.col("head"))).select(F.col("head").alias("x"), F.col("_id").alias("y"), F.lit(1.0).alias("similarity"))
    listed = across.unionByName(inside).unionByName(spread)
    return listed.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").distinct()


def group_pairs(pairs: DataFrame) -> DataFrame:
    """(``record_id``, ``group_id``, ``links``): the connected groups of pairs, each under its smallest id, and every record's number of links."""
    both = cut_lineage(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(pairs.select(F.col("id_b").alias("a"), F.col("id_a").alias("b"))))
    label = cut_lineage(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root"), F.count(F.lit(1)).alias("links")))
    moved = True
    while moved:
        heard = both.join(label.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        mid = label.join(heard, "a").select("a", "links", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        new = cut_lineage(mid.join(label.select(F.col("a").alias("mid"), F.col("root").alias("far")), "mid", "left").select("a", "links", "was", F.least("mid", F.coalesce("far", "mid")).alias("root")))
        label, moved = new.select("a", "root", "links"), new.where("root <> was").limit(1).count() > 0
    return label.select(F.col("a").alias("record_id"), F.col("root").alias("group_id"), "links")
