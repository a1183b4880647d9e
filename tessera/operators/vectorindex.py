"""Exact top-k by cosine for many queries at once, over a kept index of cells.

Unit vectors are dealt to the nearest of some centres and, by cell and distance from the
centre, into blocks of ``BLOCK`` rows; a block is one row with its vectors as a matrix.
Queries are grouped in the same way. For two unit vectors d^2 = 2 - 2 * cosine, so

1. each group first meets the block of its cell that is nearest, which gives every query
   a k-th score that can only get better;
2. by the triangle inequality a block can hold a better row only if its distances from the
   centre overlap a range that the group's queries span; other blocks are skipped;
3. each remaining pair of group and block is one matrix product, cut to k rows a query
   before anything is shuffled.

No neighbour is lost whatever the centres are. They come from a bounded sample (``SAMPLE``
vectors); they and two distances a cell, ``CELLS`` at most, are all that every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import CommitLog, folder, importable

#: Rows of a block, queries of a group, rows a cell is meant to hold at least.
BLOCK, GROUP, CELL = 1024, 256, 4096
CELLS, SAMPLE, ROUNDS = 1024, 16_384, 5
#: Rows that meet all centres at once, and queries of a group that meet a block at once: with
#: many equal vectors every pair of the two can tie for the last place.
PLACED, MET = 1024, 16
#: Slack of distances and of scores, for rounding.
EPS = 1e-7

_FIELDS = {"cell": "int", "near": "double", "far": "double", "n": "int", "ids": "array<string>", "sizes": "binary", "vecs": "binary"}
_PACKED = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
_ARROW = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary()]


def _units(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length, padded with zeros to width, and their lengths."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out / np.sqrt((out * out).sum(1))[:, None], sizes


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a length and a direction."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where((F.size(vector) > 0) & (square > 0) & (square < float("inf")))


def _packed(rows: DataFrame, most: int, centres, parts: int) -> DataFrame:
    """rows (id, v) by cell and distance from its centre, up to most together."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in (b.slice(i, PLACED) for b in batches for i in range(0, b.num_rows, PLACED)):
            unit, sizes = _units(batch.column("v").to_pylist(), c.shape[1])
            d = _distances(unit, c)
            cell = d.argmin(1) if len(unit) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(d[np.arange(len(unit)), cell]), batch.column("id"), pa.array(sizes), pa.array([x.tobytes() for x in unit], pa.binary())], names=["cell", "dist", "id", "size", "vec"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []

        def block() -> pa.RecordBatch:
            row = (own[0][0], own[0][1], own[-1][1], len(own), [r[2] for r in own], np.array([r[3] for r in own], np.int64).tobytes(), b"".join(r[4] for r in own))
            own.clear()
            return pa.record_batch([pa.array([x], kind) for x, kind in zip(row, _ARROW, strict=True)], names=list(_FIELDS))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "dist", "id", "size", "vec")), strict=True):
                if own and (own[0][0] != row[0] or len(own) == most):
                    yield block()
                own.append(row)
        if own:
            yield block()

    order = ["cell", "dist", "id"]
    dealt = rows.mapInArrow(placed, "cell int, dist double, id string, size long, vec binary")
    return dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(packed, _PACKED)


class VectorIndex:
    """Cells of unit vectors below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        importable(spark)
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    def build(self, rows: DataFrame, vector: str = "embedding", row_id: str = "id") -> VectorIndex:
        """Writes the index of rows; rows without a usable vector are left out."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        own = _usable(rows.select(F.col(row_id).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")), "v")
        shape = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).head()
        k = min(CELLS, max(1, shape["n"] // CELL))
        drawn = own.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 16 * k)).select("v").collect()
        x = _units([r["v"] for r in drawn], shape["width"] or 1)[0]
        centres = x[:k] if len(x) else np.zeros((1, 1))
        for _ in range(ROUNDS if len(x) > k else 0):
            near = _distances(x, centres).argmin(1)
            size = np.bincount(near, minlength=k)
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        blocks = _packed(own, BLOCK, self.spark.sparkContext.broadcast(centres), parts)
        blocks.withColumn("block_id", F.monotonically_increasing_id()).write.parquet(f"{self.path}/blocks")
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{self.path}/centres")
        self.log.commit({"rows": shape["n"]}, 0, lambda newer: True)
        return self

    def _read(self) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        blocks = self.spark.read.schema(f"{_PACKED}, block_id long").parquet(f"{self.path}/blocks")
        centres = np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()])
        spans = np.full((len(centres), 2), (np.inf, -np.inf))
        for r in blocks.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect():  # CELLS rows at most
            spans[r["cell"]] = r["near"], r["far"]
        return blocks, centres, spans

    def search(self, queries: DataFrame, k: int, vector: str = "q", query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
        """(found, report): query_id, id, score and rank of the k nearest rows of each query
        (ties by id: shorter texts first, so whole numbers by value), and one row with pairs_scored and pairs. Rows of another
        length than the query's don't count."""
        blocks, centres, spans = self._read()
        width = centres.shape[1]
        at = folder(self.spark, "vector-search")

        def saved(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{at}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{at}/{name}")

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        asked = _usable(queries.select(F.col(query_id).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")), "v").where(F.size("v") <= width)
        shared = self.spark.sparkContext.broadcast(centres)
        groups = saved(_packed(asked, GROUP, shared, parts).withColumn("group_id", F.monotonically_increasing_id()), "groups")
        where = blocks.select("block_id", "cell", "near", "far", "n")
        g = groups.select("group_id", "cell", ((F.col("near") + F.col("far")) / 2).alias("mid"))
        home = g.join(where, "cell").groupBy("group_id").agg(F.min_by("block_id", F.abs(F.col("mid") - (F.col("near") + F.col("far")) / 2)).alias("block_id"))
        home = saved(home, "home")
        none = F.lit(None).cast("array<double>")
        first = saved(_scored(self._pairs(home, groups.withColumn("low", none), blocks), k, width), "first")
        worst = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
        members = groups.select("group_id", F.posexplode("ids").alias("i", "id"))
        low = members.join(worst, "id", "left").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("score", F.lit(-1.0)).alias("s")))).alias("l"))
        bounded = saved(groups.join(low.select("group_id", F.transform("l", lambda x: x["s"]).alias("low")), "group_id"), "bounded")
        needs = _needs(bounded, shared, spans)
        pairs = needs.join(where, "cell").where("near <= to and far >= from").select("group_id", "block_id").join(home, ["group_id", "block_id"], "left_anti")
        pairs = saved(pairs, "pairs")
        rest = _scored(self._pairs(pairs, bounded, blocks), k, width)
        found = _best(first.unionByName(rest), k)
        met = pairs.unionByName(home).join(groups.select("group_id", F.col("n").alias("g")), "group_id").join(where.select("block_id", F.col("n").alias("b")), "block_id").agg(F.coalesce(F.sum(F.col("g").cast("long") * F.col("b")), F.lit(0)).alias("pairs_scored"))
        total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("g")).crossJoin(blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b"))).select((F.col("g") * F.col("b")).alias("pairs"))
        return found, met.crossJoin(total)

    @staticmethod
    def _pairs(pairs: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
        b = blocks.select("block_id", *[F.col(c).alias(f"b_{c}") for c in ("ids", "sizes", "vecs")])
        return pairs.join(groups.select("group_id", "ids", "sizes", "vecs", "low"), "group_id").join(b, "block_id").drop("group_id", "block_id")


def _needs(groups: DataFrame, centres, spans: np.ndarray) -> DataFrame:
    """(group_id, cell, from, to): distances from a centre at which better rows can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            for group_id, vecs, low in zip(*(batch.column(x).to_pylist() for x in ("group_id", "vecs", "low")), strict=True):
                q = np.frombuffer(vecs).reshape(-1, c.shape[1])
                reach = np.sqrt(np.maximum(2 - 2 * (np.asarray(low) - EPS), 0))[:, None] + EPS
                d = _distances(q, c)
                begin, end = (d - reach).min(0), (d + reach).max(0)
                cell = np.flatnonzero((begin <= spans[:, 1]) & (end >= spans[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array([group_id] * len(cell), pa.int64()), pa.array(cell, pa.int32()), pa.array(begin[cell]), pa.array(end[cell])], names=["group_id", "cell", "from", "to"])

    return groups.mapInArrow(run, "group_id long, cell int, from double, to double")


def _scored(pairs: DataFrame, k: int, width: int) -> DataFrame:
    """(query_id, id, score): up to k rows of each block for each query of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q, b = (np.frombuffer(r[c]).reshape(-1, width) for c in ("vecs", "b_vecs"))
                size, b_size = (np.frombuffer(r[c], np.int64) for c in ("sizes", "b_sizes"))
                low = np.full(len(q), -np.inf) if r["low"] is None else np.asarray(r["low"]) - EPS
                ids, names = np.array(r["b_ids"], object), np.array(r["ids"], object)
                keep = [best(q, b, size, b_size, low, ids, begin) for begin in range(0, len(q), MET)]
                x, y, exact = (np.concatenate(c) for c in zip(*keep, strict=True))
                yield pa.record_batch([pa.array(names[x], pa.string()), pa.array(ids[y], pa.string()), pa.array(exact, pa.float64())], names=["query_id", "id", "score"])

    def best(q, b, size, b_size, low, ids, begin) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries from begin on, rows of the block and scores: up to k a query."""
        own = slice(begin, begin + MET)
        score, least = q[own] @ b.T, low[own]
        score[size[own, None] != b_size[None]] = -np.inf
        if k < score.shape[1]:
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] - EPS)
        x, y = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        # Products of whole matrices round by place; equal vectors must have equal scores.
        exact = (q[own][x] * b[y]).sum(1)
        order = sorted(range(len(x)), key=lambda j: (x[j], -exact[j], len(ids[y[j]]), ids[y[j]]))
        seen, keep = {}, []
        for j in order:
            seen[x[j]] = seen.get(x[j], 0) + 1
            if seen[x[j]] <= k:
                keep.append(j)
        keep = np.array(keep, np.int64)
        return x[keep] + begin, y[keep], exact[keep]

    return pairs.mapInArrow(run, "query_id string, id string, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("id"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
