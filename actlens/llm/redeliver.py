"""New batches against all history: navigable small-world graph shards.

Every notice is represented by the keys that identify a publication: its detail page, each file, its act number. Keys are brought to
one spelling by JVM expressions and become points of a small vector space (hashed character trigrams of the whole key). A segment holds
the points of the history or of a run of batches, equal keys of one ente merged into one point with their smallest notice. It is cut by the
keys' hash into shards of bounded size, each a small-world graph: nearest neighbours found in random-projection leaves, points that name
this one, and random long links. A hot ente or key therefore spreads over all shards or is one point.

A batch searches the shards of all live segments by beam, each key only the shard of each segment that its hash names; every point met by
the walk is reranked by exact comparison. A shard carries the beam at which sampled searches agreed with exhaustive ones (``TUNE_RECALL``),
doubled; where that beam would reach a quarter of the shard, the shard is scored exhaustively. Then the batch adds its own segment. When
``COMPACT_EVERY`` segments of one width have gathered they are merged into one, so their number grows with the logarithm of the batches,
and a batch costs its own size times that.

Files that many unrelated notices attach are told apart when links are read: they may become common only after they made a link.
"""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.session import cut_lineage, file_system, scratch, ship, stored

#: Points of one shard on average and keys of one block of queries at most; they bound a task's memory.
SHARD_POINTS, BLOCK_KEYS = 8_192, 8_192
#: Keys of a batch up to which its blocks are sent to the shards; the shards of a larger one are moved to the blocks.
SENT_KEYS = 200_000
#: Segments of one width that are merged into one.
COMPACT_EVERY = 4
#: An attachment is no file of its own if notices with at least so many different act numbers of the ente carry it.
COMMON_NUMBERS = 3
DIM, PLACES, NEIGHBOURS, BACK_LINKS, LONG_LINKS, LEAF, TREES = 48, 10, 10, 8, 4, 256, 8
#: Points of a shard per entry point, and points opened in a step of the walk.
ENTRY, WIDTH = 8, 4
#: Points on which the beam of a shard is tuned against exhaustive search, and the recall that ends the widening.
TUNE_QUERIES, TUNE_RECALL = 1024, 0.998
#: Query parameters of links that don't name the page (fixed values).
TRACKING = r"^(?:utm_[a-z_]*|sid|csrf|_|t)(?:=.*)?$"


def _with_page(notices: DataFrame) -> DataFrame:
    """Adds ``_p``: the detail page without scheme, www, port, fragment and parameters that don't name it. One column per step: each is used more than once."""
    u = F.split(F.lower(F.trim("dettaglio_url")), "#").getItem(0)
    u = F.regexp_replace(F.regexp_replace(u, r"^[a-z]+://(?:www\.)?|^www\.", ""), r"^([^/:?]+):\d+", "$1")
    out = notices.withColumn("_u", F.split(u, r"\?", 2))
    params = F.filter(F.split(F.coalesce(F.get("_u", F.lit(1)), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    out = out.withColumn("_params", F.array_join(F.array_sort(params), "&"))
    return out.withColumn("_p", F.nullif(F.concat_ws("?", F.regexp_replace(F.get("_u", F.lit(0)), r"/+$", ""), F.nullif("_params", F.lit(""))), F.lit("")))


def file_key(link: Column) -> Column:
    """The file's name, of a parameter that names it or else of the path, without signature endings."""
    f = F.lower(F.trim(F.regexp_replace(link, "(?i)%2f", "/")))
    named = F.regexp_extract(f, r"[?&](?:file|f|filename|name)=([^&#]*)", 1)
    f = F.when(f.rlike(r"[?&](?:file|f|filename|name)="), named).otherwise(F.regexp_extract(f, r"^([^?#]*)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(f, r"^.*/", ""), r"(?:\.p7m)+$", ""), F.lit(""))


#: Ways of writing act numbers: pattern, place of the number, place of the year.
NUMBER_FORMS = (
    (r"^n\.?\s*(\d+)\s+del\s+\d{1,2}[/.-]\d{1,2}[/.-](\d{4})$", 1, 2),
    (r"^(?:n\.?\s*)?(\d+)\s*[/-]\s*(\d{2}|\d{4})$", 1, 2),
    (r"^(\d+)\s*\(anno\s+(\d{4})\)$", 1, 2),
    (r"^[a-z]+/(\d{4})/(\d+)$", 2, 1),
)


def _with_number(notices: DataFrame) -> DataFrame:
    """Adds ``number``, kind|year|number|bis: null where the number can't be read, or neither kind nor title says what it numbers."""
    again = r"\b(bis|ter|quater|quinquies)\b"
    out = notices.withColumn("_n", F.lower(F.trim("numero")))
    out = out.withColumn("_again", F.regexp_extract("_n", again, 1)).withColumn("_n", F.trim(F.regexp_replace("_n", r"[\s/]*" + again, "")))
    place = lambda which: F.coalesce(*(F.when(F.col("_n").rlike(form[0]), F.regexp_extract("_n", form[0], form[which]).cast("bigint")) for form in NUMBER_FORMS))
    out = out.withColumn("_no", place(1)).withColumn("_year", place(2))
    what = F.coalesce(F.nullif(F.lower(F.trim("tipologia")), F.lit("")), F.nullif(F.lower(F.regexp_extract(F.trim("titolo"), r"^(\S+)", 1)), F.lit("")))
    year = F.when(F.col("_year") < 100, F.col("_year") + 2000).otherwise(F.col("_year"))
    return out.withColumn("_what", what).withColumn("number", F.when(F.col("_no").isNotNull() & F.col("_what").isNotNull(), F.concat_ws("|", "_what", year, "_no", "_again")))


def key_rows(notices: DataFrame) -> DataFrame:
    """(``ente``, ``kind`` p/f/n, ``key``, ``notice_id``, ``number``, ``batch_no``): the identifying keys of every notice, each with the notice's act number."""
    ship(notices.sparkSession)
    rows = notices.where(F.col("notice_id").isNotNull() & F.col("batch_no").isNotNull())
    rows = rows.select("notice_id", F.col("batch_no").cast("int").alias("batch_no"), F.coalesce("ente", F.lit("")).alias("ente"), "dettaglio_url", "numero", "tipologia", "titolo", "allegati")
    rows = _with_number(_with_page(rows)).select("notice_id", "batch_no", "ente", "_p", "number", F.transform("allegati", file_key).alias("_f"))
    keys = F.concat(F.array(F.struct(F.lit("p").alias("kind"), F.col("_p").alias("key")), F.struct(F.lit("n").alias("kind"), F.col("number").alias("key"))), F.transform(F.coalesce("_f", F.array().cast("array<string>")), lambda x: F.struct(F.lit("f").alias("kind"), x.alias("key"))))
    flat = rows.select("ente", "notice_id", "number", "batch_no", F.inline(keys)).where(F.col("key").isNotNull())
    return flat.select("ente", "kind", "key", "notice_id", "number", "batch_no")


# --- one shard -------------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((1 << 14, DIM)).astype(np.float32)


def embed(keys: list[str]) -> np.ndarray:
    """Unit vectors of the hashed trigrams of whole keys; the last ones, where ids stand, count by place and weigh more. A direction of the
    whole key's hash is added, so that only equal keys are one point."""
    out = np.zeros((len(keys), DIM), np.float32)
    table = _directions()
    for k in range(0, len(keys), 2048):
        part = keys[k : k + 2048]
        sizes = np.fromiter((len(s) for s in part), np.int64, len(part)) + 2
        signs = np.frombuffer("".join("\0\0" + s for s in part).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        grams = signs.copy()
        grams[1:] += 104729 * signs[:-1]
        grams[2:] += 1299709 * signs[:-2]
        place = np.maximum(PLACES - (np.repeat(ends, sizes) - np.arange(len(signs))), 0)
        vectors = table[(grams * 7919 + place * 15485863) % 16381] * np.where(place > 0, 3.0, 1.0).astype(np.float32)[:, None]
        out[k : k + 2048] = np.add.reduceat(vectors, starts, axis=0)
        whole = np.fromiter((zlib.crc32(s.encode("utf-8", "replace")) for s in part), np.int64, len(part))
        out[k : k + 2048] += 3 * (table[whole % 16381] + table[(whole >> 14) % 16369])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def build_graph(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Neighbour lists of n points: near ones from random-projection leaves, points that name this one as near, and random far ones."""
    n, rng = len(x), np.random.default_rng(seed)
    near = np.tile(np.arange(n)[:, None], (1, NEIGHBOURS))
    sims = np.full((n, NEIGHBOURS), -2.0, np.float32)
    for _ in range(TREES if n > LEAF else 1):
        todo = [np.arange(n)]
        while todo:
            ids = todo.pop()
            if len(ids) > LEAF:
                side = x[ids] @ rng.standard_normal(DIM).astype(np.float32)
                order = np.argsort(side, kind="stable")
                todo += [ids[order[: len(ids) // 2]], ids[order[len(ids) // 2 :]]]
                continue
            s = x[ids] @ x[ids].T
            np.fill_diagonal(s, -2)
            k = min(NEIGHBOURS, len(ids) - 1)
            if k < 1:
                continue
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            both = np.concatenate((near[ids], ids[best]), axis=1)
            value = np.concatenate((sims[ids], np.take_along_axis(s, best, 1)), axis=1)
            order = np.argsort(both, axis=1, kind="stable")
            both, value = np.take_along_axis(both, order, 1), np.take_along_axis(value, order, 1)
            value[:, 1:][both[:, 1:] == both[:, :-1]] = -2
            top = np.argsort(-value, axis=1, kind="stable")[:, :NEIGHBOURS]
            near[ids], sims[ids] = np.take_along_axis(both, top, 1), np.take_along_axis(value, top, 1)
    source, target = np.repeat(np.arange(n), NEIGHBOURS), near.ravel()
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.tile(np.arange(n)[:, None], (1, BACK_LINKS))
    back[target[nth < BACK_LINKS], nth[nth < BACK_LINKS]] = source[nth < BACK_LINKS]
    return np.concatenate((near, back, rng.integers(0, n, (n, LONG_LINKS))), axis=1).astype(np.int32)


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
    """(len(q), beam) nearest points found, -1 beyond; all queries walk the graph together. A beam of all points compares exhaustively."""
    n, m = len(x), len(q)
    if beam >= n:
        return np.argsort(-(q @ x.T), axis=1, kind="stable")
    pivots = np.arange(0, n, ENTRY)
    k, width = min(beam, len(pivots)), min(WIDTH, beam)
    first = q @ x[pivots].T
    near = np.argpartition(-first, k - 1, axis=1)[:, :k]
    ids, sim = np.full((m, beam), -1, np.int64), np.full((m, beam), -9.0, np.float32)
    ids[:, :k], sim[:, :k] = pivots[near], np.take_along_axis(first, near, 1)
    done = ids < 0
    base = np.arange(m) * n
    seen = np.zeros(m * n, bool)
    seen[base[:, None] + pivots[near]] = True
    live = np.arange(m)
    while len(live):
        score = np.where(done[live], -9, sim[live])
        pick = np.argpartition(-score, width - 1, axis=1)[:, :width]
        good = np.take_along_axis(score, pick, 1) > -9
        going = good.any(axis=1)
        live, pick, good = live[going], pick[going], good[going]
        if not len(live):
            break
        rows = live[:, None]
        done[rows, pick] = True
        more = graph[np.where(good, ids[rows, pick], ids[rows, pick[:, :1]])].reshape(len(live), -1).astype(np.int64)
        more.sort(axis=1)
        flat = base[live][:, None] + more
        fresh = ~seen[flat]
        fresh[:, 1:] &= more[:, 1:] != more[:, :-1]
        seen[flat] = True
        r, c = np.nonzero(fresh)
        value = np.full(more.shape, -9, np.float32)
        value[r, c] = np.einsum("kd,kd->k", x[more[r, c]], q[live[r]])
        all_ids, all_sim = np.concatenate((ids[live], more), 1), np.concatenate((sim[live], value), 1)
        all_done = np.concatenate((done[live], ~fresh), 1)
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        ids[live], sim[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sim, all_done))
    ids[sim <= -9] = -1
    return ids


def tune_beam(x: np.ndarray, graph: np.ndarray) -> int:
    """Twice the smallest beam of 8, 16, 32 ... that finds ``TUNE_RECALL`` of the sampled points' exact nearest ones, the points themselves;
    all points (exhaustive search) where that would be a quarter of the shard or more."""
    n = len(x)
    sample = np.random.default_rng(3).choice(n, min(n, TUNE_QUERIES), replace=False)
    beam = 8
    while 2 * beam < n / 4:
        if (beam_search(x, graph, x[sample], beam) == sample[:, None]).any(axis=1).mean() >= TUNE_RECALL:
            return 2 * beam
        beam *= 2
    return n


def pack_shard(keys: list[str], holders: np.ndarray) -> tuple[bytes, int]:
    x = embed(keys)
    mean = x.mean(axis=0) if len(x) > 1 else np.zeros(DIM, np.float32)
    x -= mean
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    graph = build_graph(x)
    beam = tune_beam(x, graph)
    raw = [k.encode("utf-8", "surrogatepass") for k in keys]
    out = io.BytesIO()
    np.savez(out, x=x.astype(np.float16), graph=graph, mean=mean, holders=holders, keys=np.frombuffer(b"".join(raw), np.uint8), ends=np.cumsum([len(k) for k in raw]))
    return out.getvalue(), beam


class Shard:
    def __init__(self, payload: bytes):
        z = np.load(io.BytesIO(payload))
        self.x, self.graph, self.mean, self.holders = z["x"].astype(np.float32), z["graph"], z["mean"], z["holders"]
        raw, ends = z["keys"].tobytes(), z["ends"]
        self.keys = np.empty(len(ends), object)
        self.keys[:] = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def links(self, keys: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the queries whose key is met here, and that key's first holder: the points on the beam, reranked by exact comparison."""
        q = embed(list(keys)) - self.mean
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        where, holder = [], []
        for k in range(0, len(keys), 512):
            found = beam_search(self.x, self.graph, q[k : k + 512], beam)
            same = (self.keys[np.maximum(found, 0)] == keys[k : k + 512, None]) & (found >= 0)
            row, col = np.nonzero(same)
            where.append(row + k)
            holder.append(self.holders[found[row, col]])
        return np.concatenate(where), np.concatenate(holder)


# --- the index: segments of shards -------------------------------------------------------------------------------------------------------

SHARD_SCHEMA = "slice int, points int, beam int, payload binary"
POINT_SCHEMA = "point string, holder bigint"
LINK_SCHEMA = "point string, notice_id bigint, other_id bigint"
PART_SCHEMAS = {"keys": "ente string, kind string, key string, notice_id bigint, number string, point string", "points": POINT_SCHEMA, "own": LINK_SCHEMA}


def point_key() -> Column:
    """Kind, ente and key as one string: the point's name."""
    return F.concat_ws("|", "kind", "ente", "key")


def slice_of(slices: int) -> Column:
    return F.pmod(F.xxhash64("point"), F.lit(slices)).cast("int")


def build_shards(points: DataFrame, slices: int) -> DataFrame:
    """One graph per slice of ``points`` (``point``, ``holder``; one row per point)."""

    def build(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point", kind="stable")
        payload, beam = pack_shard(rows["point"].tolist(), rows["holder"].to_numpy(np.int64))
        return pd.DataFrame([(*group, len(rows), beam, payload)], columns=["slice", "points", "beam", "payload"])

    # a number of partitions of its own: few bytes make much work here, so they must not be put together by size
    return points.withColumn("slice", slice_of(slices)).repartition(2 * slices, "slice").groupBy("slice").applyInPandas(build, SHARD_SCHEMA)


def unpack_shards(shards: DataFrame) -> DataFrame:
    """The points that shards hold."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                shard = Shard(payload)
                yield pd.DataFrame({"point": shard.keys, "holder": shard.holders})

    return shards.select("payload").mapInPandas(unpack, POINT_SCHEMA)


def search_shards(points: DataFrame, count: int, segments: dict[str, tuple[int, DataFrame]]) -> DataFrame:
    """(``point``, ``notice_id``, ``other_id``): each point of a batch with the holder of the equal point of every segment (slices, shards) that has one."""
    asked = F.array(*(F.struct(F.lit(s).alias("segment"), slice_of(n).alias("slice"), F.pmod(F.hash("point"), F.lit(math.ceil(1.3 * count / n / BLOCK_KEYS))).alias("block")) for s, (n, _) in segments.items()))
    blocks = points.select("point", "holder", F.explode(asked).alias("_a")).groupBy("_a.segment", "_a.slice", "_a.block").agg(F.collect_list(F.struct("point", "holder")).alias("asked"))
    shards = reduce(DataFrame.unionByName, [d.select(F.lit(s).alias("segment"), "slice", "beam", "payload") for s, (_, d) in segments.items()])
    met = shards.join(F.broadcast(blocks) if count * len(segments) <= SENT_KEYS else blocks, ["segment", "slice"]).select("beam", "payload", F.col("asked.point").alias("points"), F.col("asked.holder").alias("holders"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                keys = np.array(list(row.points), object)
                at, other = Shard(row.payload).links(keys, row.beam)
                yield pd.DataFrame({"point": keys[at], "notice_id": np.asarray(row.holders, np.int64)[at], "other_id": other})

    return met.mapInPandas(search, LINK_SCHEMA)


class ShardIndex:
    """The index under one path: ``keys``, ``points`` and ``own`` by batch, ``links/n`` of every batch n, ``shards/from_to_slices`` of every segment.

    Batches must come in ascending order. Accepting the newest batch again replaces it; an older one that comes again is refused.
    A segment counts once it is complete; those it has swallowed are ignored and then removed, so a run that is lost on the way can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self, part: str) -> list[str]:
        fs, path = file_system(self.spark, f"{self.path}/{part}")
        success = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [p.getName() for p in found if fs.exists(success(p, "_SUCCESS"))]

    def _segments(self) -> dict[tuple[int, int], int]:
        """(first batch, last batch) -> slices of the complete segments that no other covers."""
        every = {(int(a), int(b)): int(n) for a, b, n in (name.split("_") for name in self._listed("shards"))}
        return {s: n for s, n in every.items() if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in every)}

    def _shards(self, segment: tuple[int, int], slices: int) -> DataFrame:
        return self.spark.read.schema(SHARD_SCHEMA).parquet(f"{self.path}/shards/{segment[0]}_{segment[1]}_{slices}")

    def _add(self, segment: tuple[int, int], points: DataFrame, count: int) -> None:
        slices = max(1, math.ceil(count / SHARD_POINTS))
        build_shards(points, slices).write.mode("overwrite").parquet(f"{self.path}/shards/{segment[0]}_{segment[1]}_{slices}")

    def _remove(self, segment: tuple[int, int], slices: int) -> None:
        fs, path = file_system(self.spark, f"{self.path}/shards/{segment[0]}_{segment[1]}_{slices}")
        fs.delete(path, True)

    def accept(self, batch: DataFrame, number: int) -> None:
        """Links the batch to everything delivered before and within itself, adds its segment and compacts on schedule."""
        self.accept_all(batch.withColumn("batch_no", F.lit(number)))

    def accept_all(self, notices: DataFrame) -> None:
        """Accepts the batches of ``batch_no`` one by one, in ascending order. What a batch is by itself (its keys, its points, its equal keys)
        is worked out for all of them together; history is met by search only."""
        self._write(key_rows(notices).withColumn("point", point_key()), "keys")
        keys = self._read("keys")
        numbers = {r["batch_no"] for r in notices.select("batch_no").where(F.col("batch_no").isNotNull()).distinct().toLocalIterator()}
        keys = keys.where(F.col("batch_no").isin(sorted(numbers)))
        self._write(keys.groupBy("batch_no", "point").agg(F.min("notice_id").alias("holder")), "points")
        points = self._read("points").where(F.col("batch_no").isin(sorted(numbers)))
        own = keys.join(points, ["batch_no", "point"]).where(F.col("notice_id") != F.col("holder"))
        self._write(own.select("batch_no", "point", "notice_id", F.col("holder").alias("other_id")), "own")
        counts = {r["batch_no"]: r["count"] for r in points.groupBy("batch_no").count().toLocalIterator()}
        for n in sorted(counts):
            self._accept(n, self._read("points").where(F.col("batch_no") == n).select("point", "holder"), counts[n])

    def _write(self, rows: DataFrame, part: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(f"{self.path}/{part}")

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.schema(f"{PART_SCHEMAS[part]}, batch_no int").parquet(f"{self.path}/{part}")

    def _accept(self, number: int, points: DataFrame, count: int) -> None:
        live = self._segments()
        if any(last > number or (last == number and first < last) for first, last in live):
            raise ValueError(f"batch {number} comes after a later one, or has been compacted")
        if (number, number) in live:
            self._remove((number, number), live.pop((number, number)))
        segments = {f"{a}_{b}": (n, self._shards((a, b), n)) for (a, b), n in live.items()}
        with ThreadPoolExecutor(2) as two:  # neither needs the other
            jobs = [two.submit(self._add, (number, number), points, count)]
            if segments:
                jobs.append(two.submit(search_shards(points, count, segments).write.mode("overwrite").parquet, f"{self.path}/links/{number}"))
            for job in jobs:
                job.result()
        self._compact()

    def _compact(self) -> None:
        """Merges the newest ``COMPACT_EVERY`` segments while they are equally wide; the first one, the history, stays by itself."""
        while True:
            live = self._segments()
            order = sorted(live)[1:]
            newest = order[-COMPACT_EVERY:]
            if len(newest) < COMPACT_EVERY or len({b - a for a, b in newest}) > 1:
                return
            points = reduce(DataFrame.unionByName, [unpack_shards(self._shards(s, live[s])) for s in newest])
            merged = stored(points.groupBy("point").agg(F.min("holder").alias("holder")))
            self._add((newest[0][0], newest[-1][1]), merged, merged.count())
            for s in newest:
                self._remove(s, live[s])

    def links(self) -> DataFrame:
        """(``notice_id``, ``other_id``) found so far, without those through files that are common by now."""
        files = self._read("keys").where((F.col("kind") == "f") & F.col("number").isNotNull()).select("point", "number").distinct()
        common = files.groupBy("point").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= COMMON_NUMBERS).select("point")
        found = [self.spark.read.schema(LINK_SCHEMA).parquet(f"{self.path}/links/{n}") for n in self._listed("links")]
        found = reduce(DataFrame.unionByName, found, self._read("own").select("point", "notice_id", "other_id"))
        return found.join(common, "point", "left_anti").select("notice_id", "other_id").where("notice_id <> other_id").distinct()


def first_deliveries(links: DataFrame) -> DataFrame:
    """(``kept_id``, ``dup_id``): every linked notice under the smallest id of its publication (connected links), by label propagation with
    shortcuts, until no label changes."""
    edges = cut_lineage(links.select(F.col("notice_id").alias("a"), F.col("other_id").alias("b")))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")))
    changed = True
    while changed:
        heard = both.join(label.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(heard, "a").select("a", F.least("root", "near").alias("mid"), F.col("root").alias("was"))
        jump = label.select(F.col("a").alias("mid"), F.col("root").alias("far"))
        new = cut_lineage(step.join(jump, "mid", "left").select("a", F.least("mid", F.coalesce("far", "mid")).alias("root"), "was"))
        changed = new.where(F.col("root") != F.col("was")).limit(1).count() > 0
        label = new.select("a", "root")
    return label.where(F.col("root") < F.col("a")).select(F.col("root").alias("kept_id"), F.col("a").alias("dup_id"))


def redelivered(notices: DataFrame, path: str | None = None) -> DataFrame:
    """(``kept_id``, ``dup_id``): every notice that delivers a publication of its ente again, with the first delivery.

    The batches are accepted one by one, in ascending batch_no, by an index under ``path`` (a new one in the shared folder by default).
    Columns used: notice_id, ente, batch_no, titolo, numero, tipologia, dettaglio_url, allegati; others are ignored. Null keys never match; a
    notice without any key is a publication of its own. A null ente is an ente of its own. Rows without batch_no or notice_id are not traced. A row
    delivered under the same notice_id twice counts once. An empty table gives no rows.
    """
    spark = notices.sparkSession
    ship(spark)
    index = ShardIndex(spark, path or scratch(spark))
    index.accept_all(notices)
    return first_deliveries(index.links())
