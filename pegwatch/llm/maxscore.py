"""Exact top-k search by MaxScore over integer vectors.

Every dimension is a query term and a vector's component its posting; the score is the inner product. Candidates are dealt
into shards of ``SHARD_CELLS`` components; a shard is moved to its task once, and the packed queries, which are few, follow it
there. Nothing is joined or broadcast, and no body is paired with another one.

Method, for a tile of queries within a shard: the largest and the smallest component of a dimension bound what its term can add
to a score, and the lengths of a query's and the rows' remaining components bound what a tail of terms can add together; the
lower one holds. Terms are ordered by their energy in the shard; the longest tail of terms that adds at most a part (``SHARE``) of every query's threshold (its k-th
best score so far) is non-essential. Postings of essential terms are traversed slice by slice as one matrix product; only rows whose
partial score plus the bound of the tail still competes are probed in the other terms, again with falling bounds. What ties
with the threshold goes to the smaller id. Thresholds start from rows scored in full and rise from slice to slice. The k best
of each shard are merged by a grouped ranking that is limited before its shuffle.

Components become floor(scale * x) (x as double). A vector that is null, or holds a null or non-finite component, takes no
part, neither as a query nor as a candidate; nor does a row without an id. Shorter vectors count as padded with zeros. Rows
that repeat an id and its vector count once; rows that share an id are one row's versions: none is a candidate for its
own id, and the greatest score of a candidate id counts. An empty vector scores 0. Scores beyond what
doubles hold exactly are summed as unbounded integers and saturate at 64 bits before they are ranked. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pegwatch.llm.common import ship_code
from pegwatch.session import cut

SHARD_CELLS = 1 << 22  # components of a shard, which one task holds
LEAST_ROWS = 1024  # of a shard, while there are fewer shards than cores
PACKED_CELLS = 1 << 20  # components that a packing task holds before it hands them on
SLICE_ROWS, TILE_ROWS = 4096, 512  # candidates and queries of one matrix product
SEED_ROWS = 1024  # candidates scored in full to get a first threshold
SHARE = 2  # the terms of the tail add at most this part of a threshold
PROBED = 16  # terms between two looks at the bounds
PACKED = "shard int, asked boolean, dims int, wide boolean, ids binary, body binary"


def _width(dims: int) -> int:
    """Lengths are rounded up to one of eight steps between two powers of two, so that few widths occur."""
    step = max(1, 1 << max(0, dims.bit_length() - 4))
    return -(-dims // step) * step


def _pack(rows: DataFrame, shards: int, scale: float) -> DataFrame:
    """Packed rows of one width: candidates go to the shard of their hash, queries to every shard. ids are 8-byte, the
    body has 2-byte components, row by row, or 8-byte ones (wide) where one doesn't fit."""

    def packed(held: dict[tuple[bool, int], list]) -> Iterator[pa.RecordBatch]:
        for (wide, dims), parts in held.items():
            ids, shard, asked, body = (np.concatenate(p) for p in zip(*parts, strict=True))
            places = np.argsort(shard, kind="stable")
            found = [(int(shard[p[0]]), False, p) for p in np.split(places, np.flatnonzero(np.diff(shard[places])) + 1)]
            if asked.any():
                found.append((-1, True, np.flatnonzero(asked)))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([f[0] for f in found], pa.int32()), "asked": [f[1] for f in found], "dims": pa.array([dims] * len(found), pa.int32()), "wide": [wide] * len(found),
                "ids": [ids[p].astype("<i8").tobytes() for *_, p in found], "body": [body[p].astype("<f8" if wide else "<i2").tobytes() for *_, p in found]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], list] = {}
        cells = 0
        for batch in batches:
            ids, shard, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "shard", "q"))
            flat = np.append(np.floor(scale * batch.column("v").flatten().to_numpy(zero_copy_only=False)), 0.0)
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts, widths = np.cumsum(lengths) - lengths, np.array([_width(int(n)) for n in lengths])
            for dims in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == dims)
                for part in np.array_split(rows, -(-len(rows) * max(1, dims) // PACKED_CELLS)):
                    place = np.arange(dims)
                    body = flat[np.where(place < lengths[part, None], starts[part, None] + place, len(flat) - 1)]
                    big = np.abs(body).max(1, initial=0) >= 1 << 15
                    for wide in (False, True):
                        if (big == wide).any():
                            own = part[big == wide]
                            held.setdefault((wide, dims), []).append((ids[own], shard[own], asked[own], body[big == wide].astype("f8" if wide else "i2")))
                    cells += body.size + len(part)
                    if cells >= PACKED_CELLS:
                        yield from packed(held)
                        held, cells = {}, 0
        yield from packed(held)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    every = F.when(F.col("asked"), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array("shard"))
    return dealt.select("id", "v", "q", "shard").mapInArrow(run, PACKED).withColumn("shard", F.explode(every))


def _tails(of: np.ndarray) -> np.ndarray:
    """Sums of each row from every column on, and 0 beyond the last."""
    out = np.zeros((len(of), of.shape[1] + 1))
    out[:, :-1] = np.cumsum(of[:, ::-1], axis=1)[:, ::-1]
    return out


class Postings:
    """The candidates of a shard that have one width, their terms by falling energy, with the bounds of every tail of terms."""

    def __init__(self, ids: np.ndarray, body: np.ndarray):
        x = body.astype(np.float64)
        self.order = np.argsort(-np.square(x).sum(0), kind="stable")
        self.ids, self.x = ids, np.ascontiguousarray(x[:, self.order])
        self.high, self.low = self.x.max(0), self.x.min(0)
        self.norms = np.sqrt(np.max([_tails(np.square(self.x[start:start + SLICE_ROWS])).max(0) for start in range(0, len(x), SLICE_ROWS)], axis=0))  # longest row, of the terms from each one on
        self.seeds = np.unique(ids, return_index=True)[1][:SEED_ROWS]  # of different ids, the smallest
        self.narrow = self.x.astype(np.float32) if self.norms[0] < 1 << 24 else self.x

    def of(self, queries: np.ndarray) -> np.ndarray:
        """The queries' components for these terms."""
        out = np.zeros((len(queries), len(self.order)))
        n = min(out.shape[1], queries.shape[1])
        out[:, :n] = queries[:, :n]
        return out[:, self.order]


class Best:
    """The k best of each query so far, as places of queries, ids and scores by (place, falling score, id)."""

    def __init__(self, queries: int, k: int):
        self.k, self.at, self.ids, self.scores = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.floor, self.last = np.full(queries, -np.inf), np.full(queries, np.iinfo(np.int64).max)  # the k-th score and its id

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """The greatest score of an id counts."""
        at, ids, scores = np.append(self.at, at), np.append(self.ids, ids), np.append(self.scores, scores)
        by = np.lexsort((~scores, ids, at))  # ~ turns the order of whole numbers without overflow
        at, ids, scores = at[by], ids[by], scores[by]
        new = np.append(True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1]))[:len(at)]
        at, ids, scores = at[new], ids[new], scores[new]
        by = np.lexsort((ids, ~scores, at))
        at, ids, scores = at[by], ids[by], scores[by]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.at, self.ids, self.scores = (z[place < self.k] for z in (at, ids, scores))
        full = place == self.k - 1
        self.floor[at[full]], self.last[at[full]] = scores[full], ids[full]


def search_shard(queries: np.ndarray, qids: np.ndarray, postings: Postings, best: Best) -> None:
    """Puts the candidates that are among the k best of a query into ``best``."""
    q = postings.of(queries)
    longest = np.sqrt(np.square(q).sum(1)).max(initial=0) * postings.norms[0]
    if not longest < 2.0**52:  # beyond what doubles add exactly
        return _search_exactly(q, qids, postings, best)
    x = postings.narrow if longest < 1 << 24 else postings.x  # whole numbers are exact in either
    t = q.astype(x.dtype)
    if len(postings.seeds) > best.k:  # a first threshold before any term is judged
        scores = t @ x[postings.seeds].T
        scores[qids[:, None] == postings.ids[postings.seeds]] = -np.inf
        at, row = np.nonzero(scores >= np.partition(scores, -best.k, axis=1)[:, [-best.k]])
        best.add(at, postings.ids[postings.seeds[row]], scores[at, row].astype(np.int64))
    one, other = q * postings.high, q * postings.low
    reach = np.ceil(np.sqrt(_tails(np.square(q))) * postings.norms * (1 + 1e-9))
    tail = np.minimum(_tails(np.maximum(one, other)), reach)  # most that the terms from each one on can add
    weight = np.minimum(_tails(np.maximum(np.abs(one), np.abs(other))), reach)  # most that they can change
    for start in range(0, len(x), SLICE_ROWS):
        part, ids = x[start:start + SLICE_ROWS], postings.ids[start:start + SLICE_ROWS]
        head = int(np.argmax((weight <= np.maximum(best.floor, 0)[:, None] / SHARE).all(0)))  # the terms before it are essential
        scores = t[:, :head] @ part[:, :head].T
        least = np.nextafter((best.floor - tail[:, head]).astype(x.dtype), x.dtype.type(-np.inf))
        at, row = np.divmod(np.flatnonzero(scores >= least[:, None]), len(part))
        score = scores[at, row].astype(np.float64)
        for term in range(head, q.shape[1], PROBED):  # the others are probed while competitive
            to = min(term + PROBED, q.shape[1])
            for p in range(0, len(at), 1 << 17):
                some = slice(p, p + (1 << 17))
                score[some] += np.einsum("ij,ij->i", q[at[some], term:to], part[row[some], term:to].astype(np.float64))
            left = score + tail[at, to] >= best.floor[at]
            at, row, score = at[left], row[left], score[left]
        own = ids[row]
        left = (own != qids[at]) & ((score > best.floor[at]) | (score == best.floor[at]) & (own < best.last[at]))
        if left.any():
            best.add(at[left], own[left], score[left].astype(np.int64))


def _search_exactly(q: np.ndarray, qids: np.ndarray, postings: Postings, best: Best) -> None:
    """Unbounded integers, which saturate at 64 bits."""
    whole = np.frompyfunc(int, 1, 1)
    asked = whole(q)
    for start in range(0, len(postings.ids), SLICE_ROWS):
        x, ids = whole(postings.x[start:start + SLICE_ROWS]), postings.ids[start:start + SLICE_ROWS]
        for at, qid in enumerate(qids.tolist()):
            left = np.flatnonzero(ids != qid)
            scores = np.array([_saturated(s) for s in (x[left] @ asked[at]).tolist()], np.int64)
            best.add(np.full(len(left), at), ids[left], scores)


def _saturated(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def search(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that satisfies ``is_query`` the k best other rows."""
    spark = vectors.sparkSession
    ship_code(spark)
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite).dropDuplicates(["id", "v"])
    return _search(cut(rows, "vectors"), k, scale)


def _search(rows: DataFrame, k: int, scale: float) -> DataFrame:
    spark = rows.sparkSession
    n, cells = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()
    shards = max(1, -(-cells // SHARD_CELLS), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism))
    # the stated query set against all rows: a shard is sent to its task once, and the packed queries follow it
    dealt = _pack(rows, shards, scale).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, postings = None, {}, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != at:
                    at, held, postings = r["shard"], {}, None
                ids = np.frombuffer(r["ids"], "<i8")
                body = np.frombuffer(r["body"], "<f8" if r["wide"] else "<i2").reshape(len(ids), r["dims"])
                if not r["asked"]:
                    held.setdefault((r["wide"], r["dims"]), []).append((ids, body))
                    continue
                if postings is None:
                    postings = [Postings(*(np.concatenate(p) for p in zip(*held.pop(key), strict=True))) for key in sorted(held)]
                for start in range(0, len(ids), TILE_ROWS):
                    qids, queries = ids[start:start + TILE_ROWS], body[start:start + TILE_ROWS].astype(np.float64)
                    best = Best(len(qids), k)
                    for p in postings:
                        search_shard(queries, qids, p, best)
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (qids[best.at], best.ids, best.scores)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
