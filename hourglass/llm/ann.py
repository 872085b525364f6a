"""Approximate nearest neighbours on shifted Hilbert curves, completed to an exact answer.

1. Every vector's direction is projected to a few axes, shifted and
   quantised, and gets its key on a Hilbert curve; several projections and
   shifts give several orders.
2. Each order is range-partitioned and sorted in Spark and cut into blocks
   of consecutive keys. Copies fall side by side and into as many blocks as
   they need.
3. Every query looks through its window: its own block and the two
   neighbouring ones of every order. The windows' candidates are merged and
   reranked by the inner product of the original vectors.
4. Completion. A block's centre c and radius r bound every inner product in
   it by q.c + |q| r. Blocks of the first order whose bound reaches a
   query's k-th best score are searched as well, so the answer is exact;
   where vectors cluster, almost all blocks are ruled out. Queries meet
   blocks as packs of bounded size against blocks of bounded size.

``complete=False`` stops after step 3.

Scores are double-precision sums over a vector's components, computed the
same way wherever the vector lies; ties go to the smaller id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, as query or as candidate, and neither do rows with
a null id; vectors of different lengths never meet; equal rows are merged
before blocks are cut, and rows that repeat an id with other vectors are one
candidate (the best, in every cut) and one query (the merged list); a query
never finds its own id; with fewer than k candidates all are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch, arrow_schema, map_batches, to_batch
from hourglass.llm.vectors import matrices, packed_vectors, unit

CURVES = 4
AXES, BITS = 6, 10          # a key has AXES * BITS = 60 bits
BLOCK_ROWS = 1024
PACK_BLOCKS = 8             # a pack holds the queries of so many blocks
STATES_KEPT = 64            # packs whose best rows a task holds at a time
_SEED = 20240611


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows x axes), by Skilling's transposition:
    undo excess turns from the highest bit down, Gray-code across the axes, interleave."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            up = (x[:, i] & q) != 0
            turn = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(up, x[:, 0] ^ low, x[:, 0] ^ turn)
            x[:, i] ^= turn
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[:, -1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[:, i] >> bit & 1)
    return key


def curve_keys(x: np.ndarray, curve: int) -> np.ndarray:
    """Keys of vectors on one curve: its own projection and shift."""
    rng = np.random.default_rng([_SEED, curve, x.shape[1]])
    projection = np.linalg.qr(rng.normal(size=(max(x.shape[1], AXES), AXES)))[0][:x.shape[1]]
    place = unit(x) @ projection * np.sqrt(x.shape[1]) / 8 + 0.5 + rng.uniform(-0.125, 0.125, AXES)
    return hilbert_key(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def top_of_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query place, row place, score) of each query's k best ids of a block, its own id left out.

    A matrix product finds the rows that may be the best of their id and
    their id among the k best, ties and rounding included; their scores are
    then summed row by row.
    """
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
    names, place = np.unique(ids, return_inverse=True)
    best = s
    if len(names) < len(ids):
        order = np.argsort(place, kind="stable")
        best = np.maximum.reduceat(s[:, order], np.searchsorted(place[order], np.arange(len(names))), axis=1)
    cut = np.full(len(q), -np.inf) if len(names) <= k else -np.partition(-best, k - 1, axis=1)[:, k - 1]
    if floor is not None:
        cut = np.maximum(cut, floor)
    wanted = (s >= (cut - slack)[:, None]) & (s > -np.inf)
    if len(names) < len(ids):
        wanted &= s >= best[:, place] - slack[:, None]
    at, row = np.nonzero(wanted)
    score = (q[at] * x[row]).sum(axis=1)
    return best_rows(at, row, score, ids[row], k)


def best_rows(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The k first of every query by score, then smaller id, each id once with its best score."""
    order = np.lexsort((-score, ids, query))
    query, row, score, ids = query[order], row[order], score[order], ids[order]
    if len(query):
        fresh = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])]
        query, row, score, ids = query[fresh], row[fresh], score[fresh], ids[fresh]
        order = np.lexsort((ids, -score, query))
        query, row, score = query[order], row[order], score[order]
        head = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        nth = np.arange(len(query)) - np.repeat(head, np.diff(np.r_[head, len(query)]))
        query, row, score = query[nth < k], row[nth < k], score[nth < k]
    return query, row, score


def _blocks(vectors: DataFrame, scratch: Scratch, curves: int, block_rows: int) -> DataFrame:
    """Blocks of consecutive keys of every order, numbered across partitions by ``g``."""
    def keyed(batch):
        blobs, out = batch.column("vec").to_pylist(), {k: [] for k in ("row", "curve", "dim", "key")}
        for d, (at, x) in matrices(blobs).items():
            for c in range(curves):
                for name, v in zip(out, (at, np.full(len(at), c), np.full(len(at), d), curve_keys(x, c))):
                    out[name].append(v)
        row = np.concatenate(out.pop("row"))
        return {**{k: np.concatenate(v) for k, v in out.items()},
                **{c: batch.column(c).take(row) for c in ("vec_id", "vec", "is_query")}}

    by = ["curve", "dim", "key", "vec_id"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (map_batches(vectors, keyed, "curve int, dim int, key long, vec_id long, vec binary, is_query boolean")
               .repartitionByRange(parts, *by).sortWithinPartitions(*by))
    ddl = ("curve int, dim int, part int, no long, ids array<long>, queries array<boolean>, vecs binary, "
           "center binary, radius double, n_queries long")
    target = arrow_schema(ddl)

    def cut(batches):
        part, no, held = TaskContext.get().partitionId(), 0, []

        def block(rows):
            nonlocal no
            x = np.frombuffer(b"".join(r["vec"] for r in rows), np.float64).reshape(len(rows), -1)
            center = x.mean(axis=0)
            flags = [r["is_query"] for r in rows]
            out = {"curve": [rows[0]["curve"]], "dim": [rows[0]["dim"]], "part": [part], "no": [no], "ids": [[r["vec_id"] for r in rows]],
                   "queries": [flags], "vecs": [x.tobytes()], "center": [center.tobytes()],
                   "radius": [float(np.sqrt(((x - center) ** 2).sum(axis=1).max()))], "n_queries": [sum(flags)]}
            no += 1
            return to_batch(out, target)

        for batch in batches:
            for r in batch.select(["curve", "dim", "vec_id", "vec", "is_query"]).to_pylist():
                if held and (len(held) == block_rows or (r["curve"], r["dim"]) != (held[0]["curve"], held[0]["dim"])):
                    yield block(held)
                    held = []
                held.append(r)
        if held:
            yield block(held)

    cut_blocks = scratch.put(ordered.mapInArrow(cut, ddl), "cut")
    # One row per partition: the number of blocks before it.
    sizes = sorted((r["part"], r["n"]) for r in cut_blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = np.cumsum([0] + [n for _, n in sizes]).tolist()
    before = vectors.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part int, before long")
    return cut_blocks.join(F.broadcast(before), "part").withColumn("g", F.col("before") + F.col("no")).drop("before", "part", "no")


def _found_schema() -> str:
    return "query_id long, vec_id long, score double"


def _window_candidates(blocks: DataFrame, k: int) -> DataFrame:
    """Each query's k best of its own and the two neighbouring blocks of every order."""
    asked = blocks.filter("n_queries > 0").select(
        "curve", "dim", F.col("ids").alias("q_ids"), "queries", F.col("vecs").alias("q_vecs"),
        F.explode(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1)).alias("g"))
    target = arrow_schema(_found_schema())

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                flags = np.array(r["queries"], bool)
                q = np.frombuffer(r["q_vecs"], np.float64).reshape(len(flags), -1)[flags]
                ids, q_ids = np.array(r["ids"], np.int64), np.array(r["q_ids"], np.int64)[flags]
                at, row, score = top_of_block(q, q_ids, np.frombuffer(r["vecs"], np.float64).reshape(len(ids), -1), ids, k)
                yield to_batch({"query_id": q_ids[at], "vec_id": ids[row], "score": score}, target)

    met = asked.join(blocks.select("curve", "dim", "g", "ids", "vecs"), ["curve", "dim", "g"])
    return met.select("q_ids", "queries", "q_vecs", "ids", "vecs").mapInArrow(run, _found_schema())


def _merge(found: DataFrame, k: int) -> DataFrame:
    """(query_id, best): the k best of every query, nearest first; a query has a bounded number of rows here."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))), 1, k).alias("best"))


def _completion(blocks: DataFrame, merged: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Rows of the blocks whose bound reaches a query's k-th best score."""
    first = blocks.filter("curve = 0")

    def queries(batch):
        out = {"query_id": [], "vec": [], "pack": [], "dim": []}
        for r in batch.to_pylist():
            x = np.frombuffer(r["vecs"], np.float64).reshape(len(r["ids"]), -1)
            for i in np.flatnonzero(r["queries"]):
                for name, v in zip(out, (r["ids"][i], x[i].tobytes(), r["g"] // PACK_BLOCKS, r["dim"])):
                    out[name].append(v)
        return out

    asked = map_batches(first.filter("n_queries > 0").select("g", "dim", "ids", "queries", "vecs"), queries,
                        "query_id long, vec binary, pack long, dim int")
    floor = F.when(F.size("best") >= k, F.element_at("best", k)["score"])
    packs = scratch.put(asked.join(merged.select("query_id", floor.alias("floor")), "query_id", "left")
                        .groupBy("pack", "dim").agg(F.collect_list(F.struct("query_id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))).alias("asked")),
                        "packs")
    last = packs.agg(F.max("pack")).first()[0]
    if last is None:
        return scratch.spark.createDataFrame([], _found_schema())

    def unpack(asked):
        return (np.array([a["query_id"] for a in asked], np.int64), np.frombuffer(b"".join(a["vec"] for a in asked), np.float64).reshape(len(asked), -1),
                np.array([a["floor"] for a in asked]))

    def bound(batch):
        keep = []
        for r in batch.select(["asked", "center", "radius"]).to_pylist():
            _, q, floors = unpack(r["asked"])
            size = np.sqrt((q * q).sum(axis=1))
            c = np.frombuffer(r["center"], np.float64)
            reach = q @ c + size * r["radius"] + 1e-9 * size * (np.sqrt((c * c).sum()) + r["radius"])
            keep.append(bool((reach >= floors).any()))
        index = np.flatnonzero(keep)
        return {c: batch.column(c).take(index) for c in ("pack", "dim", "g")}

    sums = first.select("g", "dim", "center", "radius", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("pack"))
    cells = scratch.put(map_batches(sums.join(packs, ["pack", "dim"]).select("pack", "dim", "g", "asked", "center", "radius"), bound,
                                    "pack long, dim int, g long"), "cells")
    target = arrow_schema(_found_schema())

    def search(batches):
        states: dict = {}

        def flush():
            for q_ids, at, ids, score in states.values():
                yield to_batch({"query_id": q_ids[at], "vec_id": ids, "score": score}, target)
            states.clear()

        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q, floors = unpack(r["asked"])
                ids = np.array(r["ids"], np.int64)
                at, row, score = top_of_block(q, q_ids, np.frombuffer(r["vecs"], np.float64).reshape(len(ids), -1), ids, k, floors)
                own = ids[row]
                if (r["pack"], r["dim"]) in states:
                    _, at_0, ids_0, score_0 = states[r["pack"], r["dim"]]
                    at, own, score = np.r_[at_0, at], np.r_[ids_0, own], np.r_[score_0, score]
                    at, place, score = best_rows(at, np.arange(len(at)), score, own, k)
                    own = own[place]
                elif len(states) >= STATES_KEPT:
                    yield from flush()
                states[r["pack"], r["dim"]] = (q_ids, at, own, score)
        yield from flush()

    met = cells.join(first.select("g", "ids", "vecs"), "g").join(packs, ["pack", "dim"])
    return met.select("pack", "dim", "asked", "ids", "vecs").mapInArrow(search, _found_schema())


def nearest(table: DataFrame, is_query: Column, scratch: Scratch, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", curves: int = CURVES, block_rows: int = BLOCK_ROWS, complete: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product of every query row.

    ``is_query`` is an expression over ``vec_id``.
    """
    vectors = (packed_vectors(table, id_col, vector_col).filter(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())
               .select("vec_id", "vec").distinct()
               .select("vec_id", "vec", F.coalesce(is_query, F.lit(False)).alias("is_query")))
    blocks = scratch.put(_blocks(vectors, scratch, curves, block_rows), "blocks")
    found = scratch.put(_window_candidates(blocks, k), "windows")
    merged = _merge(found, k)
    if complete:
        merged = scratch.put(merged, "merged")
        more = _completion(blocks, merged, scratch, k)
        kept = merged.select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score")
        merged = _merge(kept.unionByName(more), k)
    return (merged.select("query_id", F.posexplode("best").alias("nth", "b"))
            .select("query_id", (F.col("nth") + 1).alias("rank"), "b.vec_id", "b.score"))
