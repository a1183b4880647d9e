"""Operator 4: near-duplicates by HyperMinHash.

A document is its set of distinct k-word shingles. A sketch cuts the hash space
into buckets; a register holds, of the least hash in its bucket, the number of
leading zeros (6 bits) and the ten bits after the leading one (mantissa): 16
bits instead of 64. Four neighbouring registers are one 64-bit band key.

1. Documents with equal sets collapse into their smallest doc_id (the class
   representative); everything below is about representatives.
2. Representatives that share a band key meet. In each bucket all members are
   paired with a hub only, so a bucket of m gives m - 1 pairs, whatever m is.
   Hubs differ between bands.
3. Pairs whose registers rule the similarity out are dropped: every differing
   register needs a differing shingle, and large sets must also reach a
   collision-corrected estimate six standard errors below the threshold.
4. The rest is verified on the full sets, and links become components.
5. Buckets that still hold several components are compared block by block on a
   finer sketch; only pairs of different components that pass step 3 there and
   are not verified yet are verified, each in the first band that both share. Of
   buckets with equal members the first is compared.
   So no link between different components is lost and a group that hangs
   together is never expanded into pairs.

The number of bands follows the size of a set (see CLASSES); a set near the
upper end of its class is sketched for the next class too. Sets of fewer than 12
shingles are indexed exactly instead, since their few filled bands can all differ:
the keys are the set's hash and its hashes with every shingle (or two) left out that
a linked partner may lack, so linked pairs share the key of their intersection. From
12 shingles on a linked pair has fewer differing shingles than bands, and with 32
bands of four registers one at similarity 0.8 (0.85) is missed with probability
5e-8 (6e-11).

Defined results: null texts and texts without words have an empty set, are
linked with nothing and are kept. A text of fewer than k words is one shingle.
Ties go to the smaller doc_id. Repeated rows with equal text count as copies of
one doc_id and are marked alike; rows that share a doc_id but not the text are
one document of the link graph, linked by any of its texts. Rows with a null doc_id are components of their
own, of a null id, and kept. Whole texts are used, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .exactdedup import kept_rows, text_digest
from .staging import Stage, among, documents

#: (least set size, bands); four registers a band. The first class has no bands but
#: exact keys.
CLASSES = ((1, 0), (12, 14), (24, 14), (48, 20), (96, 28), (192, 32))
EXACT = 0
LOWEST, ROWS_A_BAND, MANTISSA = 0.8, 4, 10
#: From this set size on the estimate is used besides the exact bound.
ESTIMATED_FROM, SIGMAS = 192, 6
#: Fixed value of the published expected-collision formula of HyperMinHash.
COLLISIONS = 0.169919487159739093975315012348
#: Members of a bucket compared in one block; hubs of a family; registers of the
#: finer sketch that blocks are compared on.
BLOCK, HUBS, FINE = 512, 8, 512
#: Bands of all classes are numbered below this.
PLACES = 512


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, words in wordhash.chunks(text, fold=True):
        runs, at = words.runs(k)
        for i in range(len(at) - 1):
            first, last = words.first[i], words.first[i + 1]
            if last - first >= k:
                yield np.unique(runs[at[i] : at[i + 1]])
            elif last > first:
                whole = words.hash[first:last] + np.arange(1, last - first + 1, dtype=np.uint64)
                yield np.array([int.from_bytes(hashlib.blake2b(whole.tobytes(), digest_size=8).digest(), "little")], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def registers(ordered: np.ndarray, bands: int) -> np.ndarray:
    """HyperMinHash registers (uint16, 0 = empty) of a sorted set of hashes."""
    return _registers(ordered, bands * ROWS_A_BAND)


def _registers(ordered: np.ndarray, k: int) -> np.ndarray:
    limits = np.array([-(-(i << 64) // k) for i in range(k)], dtype=object).astype(np.uint64)
    first = np.searchsorted(ordered, limits)
    stop = np.append(first[1:], len(ordered))
    full = np.flatnonzero(first < stop)
    # How far the least hash of a bucket is into it, as 63 bits: exponent and mantissa.
    into = (ordered[first[full]] - limits[full]).astype(np.float64) * (k / 2.0)
    mantissa, exponent = np.frexp(np.maximum(into, 1.0))
    zeros = np.clip(63 - exponent, 0, 62).astype(np.uint16)
    out = np.zeros(k, np.uint16)
    out[full] = (zeros << MANTISSA | ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)) + 1
    return out


def class_of(n: int) -> int:
    """Index in CLASSES, or -1 for an empty set."""
    return sum(n >= least for least, _ in CLASSES) - 1


def exact_keys(ordered: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of the set and of all its subsets that can be the whole intersection with
    a linked set; two sets share one if (but for chance) such a subset is in both.

    A partner that lacks a of the n shingles has a similarity of (n - a) / n at most.
    """
    n = len(ordered)
    lacking = int((1 - threshold) * n + 1e-9)
    total = np.add.reduce(ordered, dtype=np.uint64)
    sums = [np.array([total], np.uint64)]
    if lacking > 0:
        sums.append(total - ordered)
    if lacking > 1:
        i, j = np.triu_indices(n, 1)
        sums.append(total - ordered[i] - ordered[j])
    sizes = np.repeat(np.arange(n, n - len(sums), -1), [len(x) for x in sums]).astype(np.uint64)
    return np.unique(wordhash.mixed(np.concatenate(sums) + sizes) | np.uint64(1)).view("<i8")


def sketches(ordered: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
    """(class, keys) of the set's class and, near its end, of the next."""
    n, own = len(ordered), class_of(len(ordered))
    wanted = [c for c in (own, own + 1) if 0 <= c < len(CLASSES) and n >= threshold * CLASSES[c][0]]
    return [(c, exact_keys(ordered, threshold) if c == EXACT else registers(ordered, CLASSES[c][1]).view("<i8")) for c in wanted if c != EXACT or n * (1 - threshold) >= 1 - 1e-9 or (n + 1) * threshold <= n + 1e-9]


def plausible(a: np.ndarray, b: np.ndarray, n_a: int, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of registers b can have the similarity with registers a."""
    held = (b != 0) | (a != 0)
    union = held.sum(1)
    same = ((b == a) & held).sum(1)
    total = n_a + n_b
    ok = (union - same) * (1 + threshold) <= (1 - threshold) * total + 1e-9
    ok &= np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = COLLISIONS * len(a) * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    estimate = (same - chance) / np.maximum(union, 1)
    margin = SIGMAS * np.sqrt(threshold * (1 - threshold) / np.maximum(union, 1))
    return ok & ((np.maximum(n_a, n_b) < ESTIMATED_FROM) | (estimate >= threshold - margin))


def signatures(docs: DataFrame, k: int, threshold: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, set_hash (null if empty), sketch of (doc_id, text), and carry."""
    kind = pa.list_(pa.struct([("cls", pa.int32()), ("keys", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n, digest, sketch = [], [], []
                for s in shingle_sets(part.column(1), k):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketch.append([{"cls": c, "keys": keys} for c, keys in sketches(s, threshold)])
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, kind), *[part.column(c) for c in carry]], names=["doc_id", "n_shingles", "set_hash", "sketch", *carry])

    rows = docs.select("doc_id", "text", *carry)
    carried = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sketch array<struct<cls:int,keys:array<long>>>" + carried)


def _bands(reps: DataFrame) -> DataFrame:
    """(rep, bucket, place) for every band that is not empty: bucket is a hash of the band
    and its key, place holds the set size and the band."""
    each = reps.select("rep", "n", F.explode("sketch").alias("s")).select("rep", "n", F.col("s.cls").alias("cls"), F.posexplode("s.keys").alias("pos", "key"))
    band = F.when(F.col("cls") == EXACT, F.lit(EXACT)).otherwise(F.col("cls") * 64 + F.col("pos"))
    return each.where("key <> 0").select("rep", F.xxhash64(band, "key").alias("bucket"), (F.col("n") * PLACES + band).alias("place"))


def _crowd(bands: DataFrame) -> DataFrame:
    """The rows of bands whose bucket has others too, with its size and hub: one hub a
    bucket, the same for every HUBS-th band. Bands are shuffled here only, by one column
    and as few others as can be."""
    bucket = Window.partitionBy("bucket")
    n = F.floor(F.col("place") / PLACES)
    order = F.xxhash64((F.col("place") % PLACES % HUBS).cast("int"), "rep").alias("o")
    # Dealt out first, else the window's arguments are shuffled too.
    met = bands.repartition("bucket").select("bucket", "rep", "place", F.count(F.lit(1)).over(bucket).alias("size"), F.min(F.struct(order, "rep", n.alias("n"))).over(bucket).alias("hub"))
    return met.where("size > 1").select("bucket", (F.col("place") % PLACES).cast("int").alias("band"), F.floor(F.col("place") % PLACES / 64).cast("int").alias("cls"), "rep", n.alias("n"), "size", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))


def _register_filter(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b, cls) whose registers of class cls allow the threshold; exact keys
    need no such test."""
    reps = among(reps, _ids(pairs), "rep")
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    keys = lambda x: F.filter(f"s_{x}", lambda s: s["cls"] == F.col("cls"))[0]["keys"].alias(f"k_{x}")
    sure = pairs.where(F.col("cls") == EXACT).select("a", "b")
    wide = pairs.where(F.col("cls") != EXACT).join(side("a"), "a").select("a", "b", "cls", "n_a", keys("a")).join(side("b"), "b").select("a", "b", "n_a", "n_b", "k_a", keys("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_numpy()
            lists = [batch.column(c) for c in ("k_a", "k_b")]
            offsets = [x.offsets.to_numpy() for x in lists]
            values = [x.values.to_numpy().view("<u2") for x in lists]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (v[4 * o[i] : 4 * o[i + 1]] for v, o in zip(values, offsets, strict=True))
                keep[i] = plausible(a, b[None], n_a[i], n_b[i : i + 1], threshold)[0]
            at = pa.array(np.flatnonzero(keep))
            yield pa.record_batch([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return wide.mapInArrow(run, "a long, b long").unionByName(sure).distinct()


def _ids(pairs: DataFrame) -> DataFrame:
    """(rep): the ids of either side of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("rep"))


def verified(pairs: DataFrame, docs: DataFrame, several: DataFrame, k: int, threshold: float) -> DataFrame:
    """pairs (a, b) with 100 * intersection >= 100 * threshold * union on full sets;
    of a doc_id with several texts (see _several) any may be the one.

    The text of a is sent to where that of b is: one text a pair, besides one an id.
    """
    percent = round(100 * threshold)
    ids = _ids(pairs)
    # A text of a several id that gets through the filter is one of its texts too. An
    # anti-join here would be pushed below the filter and shuffle all texts.
    texts = among(docs.select(F.col("doc_id").alias("rep"), "text"), ids.join(several, "rep", "left_anti"), "rep").unionByName(several)
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sets = zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True)
            for i, (x, y) in enumerate(sets):
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct()


def _several(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, text) of wanted (rep, set_hash), ids that several rows of docs have: one of
    the texts with that set."""
    joined = among(docs.select(F.col("doc_id").alias("rep"), "text"), wanted, "rep").join(wanted, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                text, digest = part.column("text"), part.column("set_hash").to_pylist()
                keep = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == h for s, h in zip(shingle_sets(text, k), digest, strict=True)]
                yield part.select(["rep", "set_hash", "text"]).filter(pa.array(keep))

    found = joined.select("rep", "set_hash", "text").mapInArrow(run, "rep long, set_hash binary, text string")
    return found.groupBy("rep", "set_hash").agg(F.min("text").alias("text")).select("rep", "text")


def _fine(wanted: DataFrame, docs: DataFrame, several: DataFrame, k: int) -> DataFrame:
    """(rep, fine): the finer registers of the wanted (rep), and of a few others. A
    register is cut to 8 bits (0 = empty): equal ones stay equal, so no pair is lost."""
    rest = wanted.join(several, "rep", "left_anti")
    texts = among(docs.select(F.col("doc_id").alias("rep"), "text"), rest, "rep").unionByName(several.join(wanted, "rep", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                whole = (_registers(s, FINE) for s in shingle_sets(part.column("text"), k))
                made = [np.where(r == 0, 0, r % 255 + 1).astype(np.uint8).tobytes() for r in whole]
                yield pa.record_batch([part.column("rep"), pa.array(made, pa.binary())], names=["rep", "fine"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, fine binary")


def _mixed(crowd: DataFrame) -> DataFrame:
    """(bucket, most, n_rare): buckets of crowd (bucket, band, rep, n, comp) that hold
    several components, their largest and the number of rows outside it.

    Of buckets with the same members the first is enough: a pair's first common bucket is
    never left out, since one before it with the same members would be common too.
    """
    sizes = crowd.groupBy("bucket", "comp").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("rep", "n")).alias("x"))
    largest = sizes.groupBy("bucket").agg(F.min("band").alias("band"), F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("all"), F.bit_xor("x").alias("members")).where("comps > 1")
    one = largest.groupBy("members", "all", "m").agg(F.min(F.struct("band", "bucket")).alias("b"))
    return one.select("b.bucket", F.col("m.comp").alias("most"), (F.col("all") - F.col("m.c")).alias("n_rare"))


def _dealt(inside: DataFrame) -> DataFrame:
    """Members of mixed buckets with x, y and right: what is compared in one group.

    Rows of a bucket's largest component are linked already, so only pairs with one of the
    other rows, the rare ones, are left: every member, in blocks of BLOCK (x), meets the
    rare rows, in blocks of their own (y). A bucket with few rare rows is sent about once,
    however large it is.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rare_blocks = F.ceil(F.col("n_rare") / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = inside.withColumn("x", at(blocks)).withColumn("y", every(rare_blocks)).withColumn("right", F.lit(False))
    right = inside.where("rare").withColumn("y", at(rare_blocks)).withColumn("x", every(blocks)).withColumn("right", F.lit(True))
    return left.unionByName(right)


def _across(dealt: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs (a, b) of different components within (bucket, x, y)."""
    rows = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "band", "x", "y")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        rep, comp, n = (np.array([g[c] for g in group], np.int64) for c in (4, 5, 6))
        rare, right = (np.array([g[c] for g in group], bool) for c in (7, 8))
        band_keys = group[0][1] // 64 != EXACT
        keys = np.array([g[9] for g in group], np.int64) if band_keys else None
        band = group[0][1] % 64
        fine = np.frombuffer(b"".join(g[10] for g in group), np.uint8).reshape(len(group), -1)
        for x in np.flatnonzero(right):
            # A pair of two rare rows is met twice; it counts on the side of the larger.
            other = np.flatnonzero(~right & (comp != comp[x]) & (~rare | (rep > rep[x])))
            if band_keys and len(other):
                shared = (keys[other] == keys[x]) & (keys[x] != 0)
                other = other[shared.argmax(1) == band]
            good = other[plausible(fine[x], fine[other], n[x], n[other], threshold)]
            for y in good:
                yield (rep[x], rep[y]) if rep[x] < rep[y] else (rep[y], rep[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(group: list[tuple]) -> pa.RecordBatch:
            found = set(compare(group)) if group else set()
            return pa.record_batch([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:4] != group[0][:4]:
                    yield send(group)
                    group = []
                group.append(row)
        yield send(group)

    return rows.select("bucket", "band", "x", "y", "rep", "comp", "n", "rare", "right", "keys", "fine").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_links, carry, kept.

    n_links counts the verified links of the document's class representative; carry
    are further columns of docs.
    """
    if threshold < LOWEST:
        raise ValueError(f"the classes hold for thresholds of {LOWEST} and more")
    stage = Stage(docs.sparkSession, "neardup")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
    signed = stage.save(signatures(docs, k, threshold, carry), "sketches")

    least = signed.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min_by(F.struct("doc_id", "n_shingles", "sketch"), "doc_id").alias("m"))
    reps = stage.save(least.select("set_hash", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n"), F.col("m.sketch").alias("sketch")), "reps")
    signed = stage.save(signed.drop("sketch"), "signatures")
    stage.drop("sketches")

    crowd = stage.save(_crowd(_bands(reps)), "crowd")
    members = crowd.where("rep <> hub").where(F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n"))
    pairs = members.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"), "cls").groupBy("a", "b").agg(F.min("cls").alias("cls"))
    first = stage.save(_register_filter(stage.save(pairs, "pairs"), reps, threshold), "first")
    stage.drop("pairs")

    # A doc_id that several rows have is read once.
    repeated = signed.groupBy(F.col("doc_id").alias("rep")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("rep")
    repeated = repeated.join(crowd.select("rep"), "rep", "left_semi")
    several = stage.save(_several(docs, reps.select("rep", "set_hash").join(repeated, "rep"), k), "several")
    links = stage.save(verified(first, docs, several, k, threshold), "links")
    joined = components(links, stage, "one")

    # Buckets that hold several components still.
    crowd = crowd.select("bucket", "band", "cls", "rep", "n", "size").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "cls", "rep", "n", "size", F.coalesce("comp", "rep").alias("comp"))
    crowd = stage.save(crowd, "crowd-joined")
    stage.drop("crowd")
    mixed = stage.save(_mixed(crowd), "mixed")
    inside = stage.save(crowd.join(mixed, "bucket").withColumn("rare", F.col("comp") != F.col("most")).drop("most"), "inside")
    stage.drop("crowd-joined", "mixed")
    wanted = inside.select("rep").distinct()
    fine = stage.save(_fine(wanted, docs, several, k), "fine")
    inside = inside.join(among(reps.select("rep", "sketch"), wanted, "rep").join(fine, "rep"), "rep").withColumn("keys", F.filter("sketch", lambda s: s["cls"] == F.col("cls"))[0]["keys"]).drop("sketch")
    more = stage.save(_across(_dealt(inside), threshold).join(first, ["a", "b"], "left_anti"), "more")
    stage.drop("inside", "fine", "first")
    links = stage.save(links.unionByName(verified(more, docs, several, k, threshold)), "all-links")
    stage.drop("links", "more", "several")

    joined = components(links, stage, "two")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    found = joined.withColumnRenamed("node", "rep").join(degree, "rep")
    classes = reps.select("set_hash", "rep").join(found, "rep", "left").select("set_hash", F.coalesce("comp", "rep").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = stage.save(classes, "classes")
    stage.keep("signatures", "classes")

    out = signed.join(classes, "set_hash", "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *carry).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_group(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates (five words, 0.8); pipeline stage."""
    marked = near_duplicates(docs.withColumn("digest", text_digest(F.col("text"))), carry=("digest",))
    return kept_rows(docs, marked.where("kept"))


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: three words, similarity 0.85, all documents."""
    docs = documents(spark, sf_dir)
    return near_duplicates(docs, 3, 0.85).select("doc_id", "n_shingles", "component_id", "kept", "n_links")
