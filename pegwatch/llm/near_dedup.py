"""Near-duplicate documents by SetSketch registers.

Method: the set of a document (its distinct word shingles) is sketched by registers ``floor(1 - log_b(min h))`` over
exponentially distributed hashes, truncated to a byte. Registers of a union are the larger of both, so sketches merge, and
registers of similar sets agree often, so bands of registers are the candidate keys. A candidate pair is first judged by
the joint likelihood of "larger, smaller, equal" counts of its registers, given both set sizes; what remains is verified
on the full sets.

No bucket ever gives all its pairs:

- documents with the same set are one class (map-side minima, so thousands of copies cost nothing) with a number of its
  own, given once when the classes are written; ids of documents come back at the end, so a shared id joins nothing;
- every class of a bucket is paired with the bucket's smallest class only; verified links make components;
- buckets whose classes still lie in different components are looked at again, in blocks of ``BLOCK`` classes of like
  size: first the likeliest pair of every two components is verified, which joins nearly all that belong together; then
  every pair of still different components that the registers find plausible. Pairs stay inside a block: its plan lists
  them as positions, and each text comes to the block once. A pair that links already found in its block join isn't verified
  again, and a block gives one link for each component that it joins to a smaller one, never one for each pair. So no bucket is
  capped, and a link is lost only if a pair shares no band at all (below 2e-6 at the threshold).

Verification goes by pivot: one class's set meets the texts of its candidates, salted so that a pivot with thousands of
candidates is spread over many tasks.

A null text, or one without words, has an empty set: it is its own component and is kept. A document with fewer words
than a shingle has its whole word sequence as its one shingle. Rows that share an id are judged by their own texts, each a class of its own
(such a row is kept if its component's smallest id is its id); a row
with a null id has a null component, takes part in nothing and is kept. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.llm.common import keyed_text, row_key, slices
from pegwatch.llm.components import components
from pegwatch.session import cut

WORDS, BANDS, ROWS = 5, 50, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.08, 20.0
MARGIN = 0.13  # nearly five standard errors of the estimate at the threshold
BLOCK, BLOCK_HASHES, PER_PIVOT_TASK, SPREAD = 1024, 8_000_000, 512, 8  # a block has no more classes, nor (from 64 classes on) hashes
BLOCKS = "bucket long, step int, i int, j int, cids array<bigint>, families array<bigint>, left array<int>, right array<int>"
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MULTIPLIERS = np.random.default_rng(20240607).integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. Words: runs other than space and \\t \\n \\v \\f \\r, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    size = min(width, n)
    acc = h[: n - size + 1] + np.uint64(size)
    for j in range(1, size):
        acc = (acc ^ (acc >> np.uint64(29))) * MIX + h[j: n - size + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * MIX2
    return np.unique(acc ^ (acc >> np.uint64(29)))


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes. The smallest of exponential variables is the exponential of the smallest
    uniform one, so one logarithm for each register is enough."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = ((items >> np.uint64(32)) ^ items).astype(np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(low, np.multiply.outer(h[i:i + 1024], MULTIPLIERS).min(axis=0), out=low)
    smallest = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each row pair of sketches, given the set sizes."""
    equal, more = (x == y).sum(1), (x > y).sum(1)
    less = x.shape[1] - equal - more
    u = nx / (nx + ny)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = top[:, None] * np.linspace(0, 1, 51)
    share = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = share(u[:, None] - v[:, None] * grid), share(v[:, None] - u[:, None] * grid)
    log = lambda z: np.log(np.maximum(z, 1e-9))
    fit = more[:, None] * log(p) + less[:, None] * log(q) + equal[:, None] * log(1 - p - q)
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def _likeness(x, y, nx, ny, percent: int) -> np.ndarray:
    """The estimate of each pair that could reach the threshold by its sizes and registers, -1 for the others."""
    small, large = np.minimum(nx, ny), np.maximum(nx, ny)
    out = np.full(len(nx), -1.0)
    ok = np.flatnonzero(100 * small >= percent * large)
    if len(ok):
        est = estimate(x[ok], y[ok], nx[ok].astype(float), ny[ok].astype(float))
        out[ok] = np.where(est >= percent / 100 - MARGIN, est, -1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def sketches(rows: DataFrame) -> DataFrame:
    """doc_id, h (of the text), n (size of the set), digest (of the set), regs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "h", "n", "digest", "regs"])

    return rows.mapInArrow(run, "doc_id long, h long, n long, digest binary, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    """A row for each class and band: band, bucket key and class."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * ROWS + 1, F.lit(ROWS))))
    return classes.select("cid", F.posexplode(keys).alias("band", "bucket"))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) that sizes and registers don't rule out."""
    side = lambda k: classes.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _likeness(_matrix(batch.column("ra")), _matrix(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent) >= 0
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. ``b`` is the pivot."""
    spark = pairs.sparkSession
    tasks = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_PIVOT_TASK).cast("int").alias("salts"))
    # a pivot's pairs meet its row in SPREAD places
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("a", F.lit(1)), F.lit(SPREAD)))
    copies = tasks.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    asked = dealt.join(copies, ["b", "deal"]).select(F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("cid"))
    pivots = tasks.select(F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("b").alias("cid"))
    wanted = asked.unionByName(pivots).join(classes.select("cid", "doc_id", "h"), "cid")
    texts = rows.select("doc_id", "h", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = texts.join(wanted.hint("shuffle_hash"), ["doc_id", "h"]).select("pivot", "salt", "role", "cid", "text")
    met = met.repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch):
                a, b = [], []
                for pivot, role, cid, text in zip(*(part.column(c).to_pylist() for c in ("pivot", "role", "cid", "text")), strict=True):
                    if role == 0:
                        if at != pivot:
                            at, own = pivot, shingles(text)
                        continue
                    other = shingles(text)
                    place = np.searchsorted(own, other)
                    both = int((own[np.minimum(place, len(own) - 1)] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        a.append(cid)
                        b.append(pivot)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _between(crowded: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Plausible pairs of different components within a bucket, found in blocks of classes of like size: all of them, or
    only the likeliest of every two components in a block. One row for each block that has any: its classes and the
    pairs as positions among them."""
    spark = crowded.sparkSession
    named = crowded.join(labels.select(F.col("node").alias("cid"), "family"), "cid", "left").withColumn("family", F.coalesce("family", "cid"))
    open_ = named.groupBy("bucket").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi").select("bucket")
    step = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")  # sizes that can link lie in the same or the next step
    rows = (
        named.join(open_, "bucket").join(classes.select("cid", "n", "regs"), "cid")
        .withColumn("own", step).withColumn("step", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    )
    room = F.greatest(F.lit(64.0), F.least(F.lit(float(BLOCK)), BLOCK_HASHES / F.pow(F.lit(100 / percent), F.col("step"))))
    crowd = rows.groupBy("bucket", "step").agg(F.ceil(F.count("*") / room).cast("int").alias("blocks"), F.min("family").alias("lo"), F.max("family").alias("hi"))
    rows = rows.join(crowd.where("lo < hi").drop("lo", "hi"), ["bucket", "step"])
    mine = F.pmod(F.xxhash64("cid"), "blocks").cast("int")
    rows = rows.select("bucket", "step", "band", "own", "cid", "family", "n", "regs", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("bucket", "step", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "family", "n", "own", "band", "regs")
    keys = ["bucket", "step", "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys)

    def pairs(key, group) -> tuple[list, list]:
        """Pairs are emitted in the first band and the larger size step that they share, so once."""
        mine, cid, family, n, own = (np.array([g[k] for g in group], np.int64) for k in range(5))
        if (family == family[0]).all():
            return [], []
        band = group[0][5]
        regs = np.frombuffer(b"".join(g[6] for g in group), np.uint8).reshape(len(group), REGISTERS)
        a, b, top = [], [], {}
        for x in range(len(group)):
            y = np.flatnonzero((family != family[x]) & (cid > cid[x]) & ((mine != mine[x]) | (key[2] == key[3])) & (np.maximum(own, own[x]) == key[1]))
            if not len(y):
                continue
            equal = regs[y] == regs[x]
            some = equal.sum(1) >= (percent / 100 - 0.25) * REGISTERS  # eight standard errors below what the threshold gives
            y, equal = y[some], equal[some]
            first = equal.reshape(len(y), BANDS, ROWS).all(2)
            y = y[first.any(1) & (first.argmax(1) == band)]
            if not len(y):
                continue
            like = _likeness(np.repeat(regs[x:x + 1], len(y), 0), regs[y], np.repeat(n[x:x + 1], len(y)), n[y], percent)
            y, like = y[like >= 0], like[like >= 0]
            if not best:
                a += cid[y].tolist()
                b += [int(cid[x])] * len(y)
                continue
            for i, e in zip(y.tolist(), like.tolist(), strict=True):
                two = (min(family[i], family[x]), max(family[i], family[x]))
                if e > top.get(two, (-1.0,))[0]:
                    top[two] = (e, int(cid[i]), int(cid[x]))
        likeliest = sorted(top.values(), key=lambda t: (-t[0], t[1:]))
        return a + [t[1] for t in likeliest], b + [t[2] for t in likeliest]

    def packed(key, group) -> dict | None:
        a, b = pairs(key, group)
        if not a:
            return None
        cids, at = np.unique(np.array(a + b, np.int64), return_inverse=True)
        family = {g[1]: g[2] for g in group}
        return dict(zip(keys, key, strict=True)) | {"cids": cids.tolist(), "families": [family[c] for c in cids.tolist()], "left": at[:len(a)].tolist(), "right": at[len(a):].tolist()}

    shape = pa.schema([("bucket", pa.int64()), ("step", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("cids", pa.list_(pa.int64())), ("families", pa.list_(pa.int64())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "mine", "cid", "family", "n", "own", "band", "regs")), strict=True):
                if row[:4] != at:
                    found += [packed(at, held)] if len(held) > 1 else []
                    at, held = row[:4], []
                held.append(row[4:])
            yield pa.RecordBatch.from_pylist([f for f in found if f], shape)
        if len(held) > 1 and (last := packed(at, held)):
            yield pa.RecordBatch.from_pylist([last], shape)

    return rows.mapInArrow(run, BLOCKS)


def _verified_blocks(blocks: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the components that pairs within the blocks join, on full sets, each with the smallest one it comes together with in its
    block. A text comes to a block once, however many pairs it is in; a pair that found links already join isn't verified."""
    keys = ["bucket", "step", "i", "j"]
    members = blocks.select(*keys, F.explode("cids").alias("cid")).join(classes.select("cid", "doc_id", "h"), "cid")
    texts = rows.select("doc_id", "h", "text").join(members.hint("shuffle_hash"), ["doc_id", "h"])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cids", "array<bigint>"), ("families", "array<bigint>"), ("left", "array<int>"), ("right", "array<int>"))]
    every = texts.select(*keys, F.lit(1).alias("role"), "cid", "text", *none).unionByName(
        blocks.select(*keys, F.lit(0).alias("role"), F.lit(None).cast("long").alias("cid"), F.lit(None).cast("string").alias("text"), "cids", "families", "left", "right"))
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = every.repartition(parts, *keys).sortWithinPartitions(*keys, "role")

    def linked(plan, sets) -> list[tuple[int, int]]:
        cids, families, left, right = plan
        up: dict[int, int] = {}

        def least(x: int) -> int:
            while x in up:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for x, y in zip(left, right, strict=True):
            a, b = least(families[x]), least(families[y])
            if a == b:
                continue
            one, two = sets[cids[x]], sets[cids[y]]
            both = int((one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two).sum())
            if 100 * both >= percent * (len(one) + len(two) - both):
                up[max(a, b)] = min(a, b)
        return [(x, least(x)) for x in list(up)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, sets = None, {}
        names = ("role", "cid", "text", "cids", "families", "left", "right")
        for batch in batches:
            out = []
            for role, cid, text, *new in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if role == 0:
                    out += linked(plan, sets) if plan else []
                    plan, sets = new, {}
                else:
                    sets[cid] = shingles(text)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = linked(plan, sets) if plan else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return every.mapInArrow(run, "a long, b long")


def _stars(crowded: DataFrame) -> DataFrame:
    """(a, b): every class with the pivot that it shares most buckets with, the smaller one on ties. One pair a class, however many bands
    a group of near copies shares; whatever they leave apart comes to the blocks, as does every other bucket of different components."""
    shared = crowded.where("cid > pivot").repartition("cid").groupBy("cid", "pivot").agg(F.count("*").alias("bands"))
    return shared.groupBy(F.col("cid").alias("a")).agg(F.min_by("pivot", F.struct(-F.col("bands"), "pivot")).alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the row's text), n_shingles, component_id, kept, for every row."""
    rows = keyed_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(F.col("text")).alias("h"))
    sketched = cut(sketches(rows), "sketches")
    least = F.min(F.struct("doc_id", "h"))
    classes = sketched.where("n > 0 and doc_id is not null").groupBy("digest").agg(least.alias("rep"), F.min("n").alias("n"), F.min("regs").alias("regs"))
    # the numbers are unique in whatever run of the write is kept, and fixed from then on
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "rep.doc_id", "rep.h", "n", "digest", "regs"), "classes")
    bands = _bands(classes)
    pivots = bands.groupBy("bucket").agg(F.min("cid").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("bucket", "pivot")
    crowded = cut(bands.join(pivots, "bucket"), "crowded")
    stars = _stars(crowded)
    likely = cut(_likely(stars, classes, percent), "likely")
    links = cut(_verified(likely, classes, rows, percent), "links")
    labels = components(links)
    for best in (True, False):  # most components meet by their likeliest pairs; then nothing is left out
        blocks = cut(_between(crowded.select("band", "bucket", "cid"), labels, classes, percent, best), "blocks")
        late = cut(_verified_blocks(blocks, classes, rows, percent), "late_links")
        if not late.isEmpty():
            links = links.unionByName(late)
            labels = components(links)
    # a class holds its smallest doc_id; only classes with links are named anew
    linked = cut(classes.select("cid", "doc_id", "digest").join(labels.withColumnRenamed("node", "cid"), "cid"), "linked_classes")
    least = linked.groupBy("family").agg(F.min("doc_id").alias("least"))
    named = classes.select("digest", "doc_id").join(linked.join(least, "family").select("digest", "least"), "digest", "left").select("digest", F.coalesce("least", "doc_id").alias("component"))
    out = sketched.select("doc_id", "h", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
