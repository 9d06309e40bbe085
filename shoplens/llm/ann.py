"""Approximate nearest neighbours by pruned proximity graphs, shard by shard.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id.
Each shard builds a directed graph: every point is searched for in the graph
built so far; the points met are its candidates; robust pruning keeps the
nearest candidate and drops those that are closer to it than to the point
(by a factor ``alpha``), and so on, which keeps near and far edges of different
directions; edges back are added and pruned alike. Two passes, the second with
the relaxed ``alpha``. The index (ids, vectors, edges) is a written table, one
row a shard.

Every query is searched for in every shard of its vector length. A shard's
index and the queries of a lane (``LANE`` queries, dealt by a hash of their id)
are shuffled to one place, the index in front: it is read once, and the queries
stream past it in blocks, where a beam search from the shard's central point
finds the candidates. So an index is sent once a lane, not once a block, and
weighs little beside the queries it meets. Distances are then computed in
double precision on the original components, and the nearest of all shards are
ranked. Only points that a query has not met yet cost it a distance.

Equal vectors of a shard are one graph point that lists its ids, so a vector
shared by a third of all rows costs one point a shard, and ties go to the
smaller id exactly.

Searches of many points run side by side as array operations.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part; vectors of another length than the query's are no
candidates; of rows that repeat an id the smallest vector counts; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import stage_table

SHARD, DEGREE, BEAM, ALPHA, BLOCK = 16384, 32, 40, 1.2, 512
LANE = 1 << 18
RESULT = "query_id long, vec_id long, score double"


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int):
    """Greedy search of many queries at once: (ids, squared distances) of the
    ``beam`` nearest points met, and the mask of those expanded. Free slots
    have id -1 and infinite distance."""
    n, b = len(x), len(q)
    sq, qq = (x * x).sum(1), (q * q).sum(1)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0] = start
    dist[:, 0] = np.maximum(sq[start] - 2.0 * (q @ x[start]) + qq, 0.0)
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        open_dist = np.where(done[live], np.inf, dist[live])
        best = open_dist.argmin(1)
        go = np.isfinite(open_dist[np.arange(len(live)), best])
        live, best = live[go], best[go]
        if not len(live):
            break
        done[live, best] = True
        out = edges[ids[live, best]]
        fresh = (out >= 0) & ~seen[live[:, None], np.maximum(out, 0)]
        row, col = np.nonzero(fresh)
        new, by = out[row, col], live[row]
        seen[by, new] = True
        d = np.full(out.shape, np.inf, np.float32)
        d[row, col] = np.maximum(sq[new] - 2.0 * np.einsum("nd,nd->n", x[new], q[by]) + qq[by], 0.0)
        all_ids = np.concatenate((ids[live], np.where(fresh, out, -1)), 1)
        all_dist = np.concatenate((dist[live], d), 1)
        all_done = np.concatenate((done[live], np.zeros_like(fresh)), 1)
        keep = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        rows = np.arange(len(live))[:, None]
        ids[live], dist[live], done[live] = all_ids[rows, keep], all_dist[rows, keep], all_done[rows, keep]
    return ids, dist, done


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of many points from their candidates (rows; -1 pads)."""
    b = len(points)
    cand = np.where(cand == points[:, None], -1, cand)
    order = np.sort(cand, 1)
    cand = np.where(np.concatenate((np.zeros((b, 1), bool), order[:, 1:] == order[:, :-1]), 1), -1, order)
    safe = np.maximum(cand, 0)
    v = x[safe]
    diff = v - x[points][:, None, :]
    d = np.where(cand >= 0, np.einsum("bmd,bmd->bm", diff, diff), np.inf)
    sq = np.einsum("bmd,bmd->bm", v, v)
    between = np.maximum(sq[:, :, None] + sq[:, None, :] - 2.0 * np.matmul(v, v.transpose(0, 2, 1)), 0.0)
    out = np.full((b, degree), -1, np.int64)
    rows = np.arange(b)
    for k in range(degree):
        best = d.argmin(1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        out[ok, k] = cand[ok, best[ok]]
        gone = alpha * alpha * between[rows, best] <= d
        gone[rows, best] = True
        d = np.where(gone & ok[:, None], np.inf, d)
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 11,
                batch: int = 256) -> tuple[np.ndarray, int]:
    """(edges, central point): edges is an array of up to 1.5 ``degree`` targets a point."""
    n, room = len(x), degree + degree // 2
    rng = np.random.default_rng(seed)
    edges = np.full((n, room), -1, np.int64)
    if n > 1:
        first = rng.integers(0, n - 1, (n, min(degree, n - 1)))
        edges[:, :first.shape[1]] = first + (first >= np.arange(n)[:, None])
    middle = x.mean(0)
    start = int(((x - middle) ** 2).sum(1).argmin()) if n else 0
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            points = order[i:i + batch]
            ids, _, _ = beam_search(x, edges, start, x[points], beam)
            new = robust_prune(x, points, np.concatenate((ids, edges[points]), 1), degree, a)
            edges[points] = -1
            edges[points, :degree] = new
            src, dst = np.repeat(points, degree), new.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            # edges back, grouped by target; a target that overflows is pruned
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            has = (edges[dst] == src[:, None]).any(1)
            src, dst = src[~has], dst[~has]
            targets, at, count = np.unique(dst, return_index=True, return_counts=True)
            if not len(targets):
                continue
            used = (edges[targets] >= 0).sum(1)
            slot = np.arange(len(dst)) - np.repeat(at, count) + np.repeat(used, count)
            wide = np.full((len(targets), room + int(count.max())), -1, np.int64)
            wide[:, :room] = np.sort(edges[targets], 1)[:, ::-1]
            wide[np.repeat(np.arange(len(targets)), count), slot] = src
            total = used + count
            fits = total <= room
            edges[targets[fits]] = wide[fits][:, :room]
            over = np.flatnonzero(~fits)
            for j in range(0, len(over), 512):
                part = over[j:j + 512]
                most = int(total[part].max())
                edges[targets[part]] = -1
                edges[targets[part], :degree] = robust_prune(x, targets[part], wide[part][:, :most], degree, a)
    return edges, start


def _merge_equal(ids: np.ndarray, x: np.ndarray):
    """(distinct vectors, ids sorted within a vector, first position of each vector's ids)."""
    x = x + np.float64(0.0)                                     # -0.0 equals 0.0
    flat, where = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, where.ravel()))
    first = np.searchsorted(where.ravel()[order], np.arange(len(flat) + 1))
    return flat, ids[order], first


def _vectors(column) -> np.ndarray:
    import pyarrow as pa
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if isinstance(column, (pa.ListArray, pa.LargeListArray)) else values


def _pack(**arrays) -> bytes:
    import io
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(body: bytes):
    import io
    return np.load(io.BytesIO(body))


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, one row an id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").where(~bad)
    return rows.where(F.exists("v", lambda e: e != 0.0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def build_index(vectors: DataFrame, shard_rows: int = SHARD) -> tuple[DataFrame, int]:
    """Index table (shard, body) of usable (vec_id, v) rows, and the number of
    shards a vector length is dealt to."""
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    key = F.shiftleft(F.size("v").cast("long"), 32) + F.pmod(F.xxhash64("vec_id"), F.lit(shards))

    def build(key, table):
        import pyarrow as pa
        table = table.combine_chunks()
        ids = table.column("vec_id").to_numpy()
        x = _vectors(table.column("v").combine_chunks())
        flat, ids, first = _merge_equal(ids, x)
        edges, start = build_graph(flat.astype(np.float32))
        single = flat.astype(np.float32)
        body = _pack(ids=ids, first=first, x=single if (single == flat).all() else flat,
                     edges=edges.astype(np.int32), start=np.int64(start))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([body], pa.binary())})

    index = vectors.withColumn("shard", key).groupBy("shard").applyInArrow(build, "shard long, body binary")
    return stage_table(index, "ann_index"), shards


def search_shard(index, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int):
    """(query id, vector id, distance) of the ``k`` nearest found in one shard."""
    x, ids, first = index["x"], index["ids"], index["first"]
    found, _, _ = beam_search(x.astype(np.float32, copy=False), index["edges"], int(index["start"]),
                              q.astype(np.float32), beam)
    out_q, out_v, out_d = [], [], []
    for i in range(len(q)):
        hit = found[i][found[i] >= 0]
        diff = x[hit].astype(np.float64) - q[i]
        d = np.sqrt((diff * diff).sum(1))
        reach = np.minimum(first[hit + 1] - first[hit], k + 1)  # the query's own id may be one of them
        at = np.concatenate([np.arange(first[h], first[h] + r) for h, r in zip(hit, reach, strict=True)])
        v, d = ids[at], np.repeat(d, reach)
        other = v != query_ids[i]
        v, d = v[other], d[other]
        best = np.lexsort((v, d))[:k]
        out_q.append(np.full(len(best), query_ids[i]))
        out_v.append(v[best])
        out_d.append(d[best])
    return tuple(np.concatenate(c) for c in (out_q, out_v, out_d))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = SHARD, beam: int = 160, lane_rows: int = LANE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors``
    found for each row of ``queries``, without the query's own id."""
    index, shards = build_index(stage_table(_usable(vectors, id_col, vec_col), "ann_vectors"), shard_rows)
    ask = stage_table(_usable(queries, id_col, vec_col), "ann_queries")
    lanes = max(1, -(-ask.count() // lane_rows))
    to = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")),
                     lambda s: F.shiftleft(F.size("v").cast("long"), 32) + s)
    lane = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lanes))
    asked = ask.select(F.explode(to).alias("shard"), lane.alias("lane"), F.lit(None).cast("binary").alias("body"),
                       "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))
    bodies = index.select("shard", every.alias("lane"), "body",
                          F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"))
    both = bodies.unionByName(asked).repartition(2 * shards * lanes, "shard", "lane")
    both = both.sortWithinPartitions("shard", "lane", F.col("body").isNull())

    def search(batches):
        import pyarrow as pa
        at, index = None, None
        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in ("shard", "lane")], 1)
            front = b.column("body").is_valid().to_numpy(zero_copy_only=False)
            cut = front.copy()
            cut[1:] |= front[:-1] | (place[1:] != place[:-1]).any(1)
            cut[0] = True
            cuts = [*np.flatnonzero(cut).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if front[i]:
                    at, index = tuple(place[i]), dict(_unpack(b.column("body")[i].as_py()))
                    continue
                if at != tuple(place[i]):                       # no vector has the queries' length
                    continue
                for m in range(i, j, BLOCK):
                    part = b.slice(m, min(BLOCK, j - m))
                    got = search_shard(index, part.column("vec_id").to_numpy(zero_copy_only=False),
                                       _vectors(part.column("v")), k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()),
                                                      pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(search, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
