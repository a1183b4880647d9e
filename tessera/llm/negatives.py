"""Operator 12: hard-negative mining by a Voronoi-partitioned kNN join.

A score is an inner product. With one more component, sqrt(M^2 - |x|^2) for rows and 0
for anchors (M: the largest norm), the row of the largest score is the nearest one:
d^2 = |a|^2 + M^2 - 2 * score. In that space

1. rows go to the nearest of some pivots (``cells``) and, by cell and distance, into
   blocks of ``BLOCK`` rows; anchors of neighbouring blocks make groups;
2. a search joins every group with the blocks its anchors stand in, which bounds the
   scores that can still matter;
3. the bounds and the triangle inequality give, for each group and cell, the distances
   to the pivot that a row must have to serve any anchor of the group; blocks that
   overlap them are replicated to that group, no others;
4. each pair of group and block is joined exactly, as one matrix product, and leaves at
   most k rows an anchor; the best of all of them are the result.

There are two searches: the best rows of the anchor's own label (positives), then, for
each positive, the best rows of other labels in a range of scores (negatives).

Pivots come from a bounded sample (``SAMPLE`` rows, refined by k-means); any pivots give
right results, they decide only how much is pruned. What goes to every task is the
pivots and two distances a cell, ``PIVOTS`` of them at most.

Defined results: rows with a null id, a null label, a null vector or a null or non-finite
component take no part; of rows that share an id the one with the least label and vector
does; a shorter vector counts as if it ended in zeros; ties go to the smaller id; an anchor
without positives, or a positive without negatives, has no rows; empty tables give none.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import Stage, n_partitions

#: Rows of a block, anchors of a group, rows a cell is meant to hold at least.
BLOCK, GROUP, CELL = 1024, 256, 4096
#: Pivots at most, and rows of the sample that they are fitted on.
PIVOTS, SAMPLE, ROUNDS = 1024, 16_384, 5
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these tenths of the positive's.
LOW, HIGH = 3, 9
#: Slack of distances, for rounding.
EPS = 1e-6

_FAR = np.iinfo(np.int64).max
_BLOCK = "cell int, near double, far double, n int, ids binary, labels binary, vecs binary"
_GROUP = "cell int, n int, ids binary, labels binary, vecs binary, homes array<long>"


def quantised(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part, one an id."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = rows.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    best = own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return best.select("vec_id", "r.label", "r.v")


def _matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Space:
    """Pivots in the augmented space, one row each."""

    def __init__(self, dims: int, most: float, pivots: np.ndarray):
        self.dims, self.most, self.pivots = dims, most, pivots

    def lifted(self, m: np.ndarray) -> np.ndarray:
        m = m.astype(float)
        return np.column_stack([m, np.sqrt(np.maximum(self.most - (m * m).sum(1), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum((lifted * lifted).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * lifted @ p.T, 0))


def _space(rows: DataFrame) -> _Space:
    """Pivots fitted on a bounded sample: the SAMPLE rows of the least hashes."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(norm).alias("most")).head()
    n, dims = stats["n"], stats["dims"] or 0
    space = _Space(dims, (stats["most"] or 0.0) * (1 + 1e-12), np.zeros((1, dims + 1)))
    k = min(PIVOTS, max(1, n // CELL))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, 16 * k)).select("v").collect()
    x = space.lifted(_matrix([r["v"] for r in drawn], dims))
    space.pivots = x[:k] if len(x) else space.pivots
    for _ in range(ROUNDS if len(x) > k else 0):
        own = space.distances(x).argmin(1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(space.pivots)
        np.add.at(total, own, x)
        space.pivots = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], space.pivots)
    return space


def _cells(rows: DataFrame, space) -> DataFrame:
    """Rows with their cell and their distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for batch in batches:
            m = _matrix(batch.column("v").to_pylist(), s.dims)
            d = s.distances(s.lifted(m))
            cell = d.argmin(1)
            vecs = pa.array([x.tobytes() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(d[np.arange(len(m)), cell]), batch.column("vec_id"), batch.column("label"), vecs], names=["cell", "dist", "vec_id", "label", "vec"])

    return rows.mapInArrow(run, "cell int, dist double, vec_id long, label long, vec binary")


def _packed(rows: DataFrame, most: int, schema: str, home: bool) -> DataFrame:
    """Sorted rows packed, up to most of one cell together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush(t: pa.RecordBatch) -> tuple:
            binary = lambda c: np.asarray(t.column(c).to_numpy(zero_copy_only=False), np.int64).tobytes()
            own = (binary("vec_id"), binary("label"), b"".join(t.column("vec").to_pylist()))
            cell, n = t.column("cell")[0].as_py(), t.num_rows
            if home:
                return (cell, n, *own, sorted(set(t.column("block_id").to_pylist())))
            return (cell, t.column("dist")[0].as_py(), t.column("dist")[n - 1].as_py(), n, *own)

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            if not table.num_rows:
                return
            t = table.to_batches()[0]
            cell = t.column("cell").to_numpy()
            borders = [*np.flatnonzero(np.diff(cell, prepend=-1)).tolist(), len(cell)]
            cuts = [c for a, b in zip(borders[:-1], borders[1:], strict=True) for c in range(a, b, most)] + [len(cell)]
            # The last one may go on in the next batch.
            upto = len(cuts) - 1 if last else len(cuts) - 2
            rows = [flush(t.slice(a, b - a)) for a, b in zip(cuts[:upto], cuts[1 : upto + 1], strict=True)]
            if not last:
                waiting.append(t.slice(cuts[upto]))
            if rows:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        kinds = [{"int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in schema.split(", ")]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 2 * most:
                yield from packed(False)
        if waiting:
            yield from packed(True)

    parts = n_partitions(rows.sparkSession)
    order = ["cell", "dist", "vec_id"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _anchors(blocks: DataFrame, is_anchor, width: int) -> DataFrame:
    """The anchors of the blocks, one row each; is_anchor takes an array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                at = np.flatnonzero(is_anchor(ids))
                if len(at):
                    vecs = [r["vecs"][8 * width * i : 8 * width * (i + 1)] for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([r["cell"]] * len(at), pa.int32()), pa.array([r["near"]] * len(at), pa.float64()), pa.array(ids[at]), pa.array(labels[at]), pa.array(vecs, pa.binary()), pa.array([r["block_id"]] * len(at), pa.int64())], names=["cell", "dist", "vec_id", "label", "vec", "block_id"])

    return blocks.mapInArrow(run, "cell int, dist double, vec_id long, label long, vec binary, block_id long")


def _needs(groups: DataFrame, space, spans) -> DataFrame:
    """(group_id, cell, from, to): the distances from a cell's pivot at which rows can serve.

    groups have ids, vecs and wants: for each search of an anchor the least and the
    largest score that still matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for batch in batches:
            for r in batch.to_pylist():
                ids, low, high = _wanted(r)[1:4]
                if not len(ids):
                    continue
                m = np.frombuffer(r["vecs"], np.int64).reshape(r["n"], s.dims)[ids].astype(float)
                square = (m * m).sum(1)
                reach = np.sqrt(np.maximum(square + s.most - 2.0 * np.where(low == -_FAR, -np.sqrt(square * s.most), low), 0)) + EPS
                least = np.sqrt(np.maximum(square + s.most - 2.0 * np.where(high == _FAR, np.sqrt(square * s.most), high), 0)) - EPS
                d = s.distances(np.column_stack([m, np.zeros(len(m))]))
                begin = np.maximum(d - reach[:, None], least[:, None] - d).min(0) - EPS
                end = (d + reach[:, None]).max(0) + EPS
                cell = np.flatnonzero((begin <= spans[:, 1]) & (end >= spans[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array([r["group_id"]] * len(cell), pa.int64()), pa.array(cell, pa.int32()), pa.array(begin[cell]), pa.array(end[cell])], names=["group_id", "cell", "from", "to"])

    return groups.mapInArrow(run, "group_id long, cell int, from double, to double")


def _wanted(r: dict) -> tuple[np.ndarray, ...]:
    """Searches of a group: key, number of the anchor, least and largest score."""
    ids = np.frombuffer(r["ids"], np.int64)
    order = np.argsort(ids)
    w = r["wants"] or []
    anchor = np.array([x["anchor_id"] for x in w], np.int64)
    at = order[np.searchsorted(ids[order], anchor)] if len(w) else anchor
    pick = lambda k, none: np.array([none if x[k] is None else x[k] for x in w], np.int64)
    return pick("key", 0), at, pick("low", -_FAR), pick("high", _FAR)


def _search(pairs: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, key, id, score): the best k of each pair of group and block."""
    names = ["anchor_id", "key", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                key, at, low, high = _wanted(r)
                if not len(key):
                    continue
                a_ids, a_labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                ids, labels = np.frombuffer(r["b_ids"], np.int64), np.frombuffer(r["b_labels"], np.int64)
                a, b = np.frombuffer(r["vecs"], np.int64).reshape(len(a_ids), dims), np.frombuffer(r["b_vecs"], np.int64).reshape(len(ids), dims)
                size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dims
                own, back = np.unique(at, return_inverse=True)
                score = (a[own].astype(float) @ b.T.astype(float)).astype(np.int64) if size < 2**53 else a[own] @ b.T
                agree = (a_labels[own][:, None] == labels[None]) == same
                agree &= a_ids[own][:, None] != ids[None]
                s = score[back]
                q, c = np.nonzero(agree[back] & (s >= low[:, None]) & (s <= high[:, None]))
                v = s[q, c]
                order = np.lexsort((ids[c], -v, q))
                q, c, v = q[order], c[order], v[order]
                begin = np.searchsorted(q, q)
                keep = np.arange(len(q)) - begin < k
                q, c, v = q[keep], c[keep], v[keep]
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[at[q]]), pa.array(key[q]), pa.array(ids[c]), pa.array(v)], names=names)

    return pairs.mapInArrow(run, "anchor_id long, key long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and key, with rank; each task cuts before the shuffle."""
    w = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Join:
    """Blocks and groups of one set of rows, and exact searches over them."""

    def __init__(self, rows: DataFrame, is_anchor):
        spark = rows.sparkSession
        self.stage = Stage(spark, "negatives")
        rows = self.stage.save(rows, "rows")
        space = _space(rows)
        self.dims, self.space = space.dims, spark.sparkContext.broadcast(space)
        blocks = _packed(_cells(rows, self.space), BLOCK, _BLOCK, False)
        self.blocks = self.stage.save(blocks.withColumn("block_id", F.monotonically_increasing_id()), "blocks")
        groups = _packed(_anchors(self.blocks, is_anchor, space.dims), GROUP, _GROUP, True)
        self.groups = self.stage.save(groups.withColumn("group_id", F.monotonically_increasing_id()), "groups")
        self.members = self.stage.save(self.groups.mapInArrow(_members, "group_id long, anchor_id long"), "members")
        self.spans = np.full((len(space.pivots), 2), (np.inf, -np.inf))
        for r in self.blocks.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect():  # PIVOTS rows at most
            self.spans[r["cell"]] = r["near"], r["far"]
        self.stage.drop("rows")

    def _joined(self, pairs: DataFrame, groups: DataFrame) -> DataFrame:
        block = self.blocks.select("block_id", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("vecs").alias("b_vecs"))
        return pairs.join(groups.drop("homes", "cell"), "group_id").join(block, "block_id")

    def search(self, wants: DataFrame, name: str, k: int, same: bool) -> DataFrame:
        """The k best rows of each search (anchor_id, key, low, high), bounds null if open."""
        wants = self.stage.save(wants, f"{name}-wants")
        groups = self._with(wants)
        home = self.groups.select("group_id", F.explode("homes").alias("block_id"))
        first = self.stage.save(_search(self._joined(home, groups), self.dims, k, same), f"{name}-first")
        worst = _best(first, k).where(F.col("rank") == k).select("anchor_id", "key", F.col("score").alias("worst"))
        bound = wants.join(worst, ["anchor_id", "key"], "left").select("anchor_id", "key", F.coalesce("worst", "low").alias("low"), "high")
        groups = self.stage.save(self._with(bound), f"{name}-groups")
        needs = _needs(groups, self.space, self.spans)
        where = self.blocks.select("block_id", "cell", "near", "far")
        pairs = needs.join(where, "cell").where("near <= to and far >= from").select("group_id", "block_id").join(home, ["group_id", "block_id"], "left_anti")
        pairs = self.stage.save(pairs, f"{name}-pairs")
        rest = _search(self._joined(pairs, groups), self.dims, k, same)
        out = self.stage.save(_best(first.union(rest), k), name)
        self.stage.drop(f"{name}-first", f"{name}-groups", f"{name}-wants", f"{name}-pairs")
        return out

    def _with(self, wants: DataFrame) -> DataFrame:
        """Groups with the searches of their anchors; GROUP anchors bound the list."""
        own = wants.join(self.members, "anchor_id").groupBy("group_id").agg(F.collect_list(F.struct("anchor_id", "key", "low", "high")).alias("wants"))
        return self.groups.join(own, "group_id")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g, ids in zip(batch.column("group_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            own = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g)), pa.array(own)], names=["group_id", "anchor_id"])


def hard_negatives(rows: DataFrame, is_anchor=lambda ids: ids % 100 == 0, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores of (vec_id, label, v).

    is_anchor takes an array of ids; positives are the best rows of the anchor's label,
    negatives the best rows of other labels within LOW to HIGH tenths of the positive.
    """
    join = _Join(rows, is_anchor)
    nothing = F.lit(None).cast("long")
    near = join.search(join.members.select("anchor_id", F.lit(0).cast("long").alias("key"), nothing.alias("low"), nothing.alias("high")), "positives", positives, True)
    # Whole tenths: 3 * p / 10 rounds up, 9 * p / 10 down; a range that is empty asks nothing.
    p = F.col("score")
    tenth = lambda x: F.expr(f"cast(floor(({x}) / 10D) as bigint)")
    asked = near.select("anchor_id", F.col("id").alias("key"), (-tenth(f"-{LOW} * score")).alias("low"), tenth(f"{HIGH} * score").alias("high")).where("low <= high")
    far = join.search(asked, "negatives", negatives, False)
    scores = near.select("anchor_id", F.col("id").alias("key"), p.alias("positive_score"))
    out = far.join(scores, ["anchor_id", "key"])
    return out.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def moved(label: Column, vec_id: Column) -> Column:
    """Every seventh id gets the next of ten labels."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return hard_negatives(quantised(rows.withColumn("label", moved(F.col("label"), F.col("vec_id")))))


SQL = f"""
with e as (select vec_id, min({{'label': case when vec_id % 7 = 0 then (label + 1) % 10 else label end, 'v': list_transform(embedding, lambda x: floor(x::double * 256)::bigint)}}) as r
    from embeddings where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by vec_id),
v as (select vec_id, r.label as label, r.v as v from e),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES})
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= {NEGATIVES}
"""
