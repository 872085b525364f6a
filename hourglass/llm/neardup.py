"""Embedding near-dedup: cross-polytope hashing with multiprobe, verified links, no pairs of large groups.

1. Equal vectors are one class with a multiplicity.
2. Hash. A vector is turned by three rounds of random signs and a fast
   Hadamard transform; the largest coordinate and its sign name one of 2d
   corners of the cross-polytope. A table joins the corners of ``K``
   rotations; probes swap in the next-best corners at least loss. K grows as
   the logarithm of the number of classes, so that buckets of unrelated
   vectors stay small, and the number of tables follows from K so that a
   pair at the threshold is met with a chance of about 0.999.
3. Balls. In three rounds of buckets the smallest class of each bucket takes
   all within half the threshold's angle. Two members of a ball are then
   within the whole angle, so a ball of m vectors holds m - 1 links of each
   member and none of its pairs is ever written.
4. Candidate balls share a bucket of some table (own or probed), by their
   members. Their pivots' angle and their radii decide most pairs as a
   whole: all members link, or none. Only the rest is compared, member by
   member, in blocks of bounded size that give counts, not pairs.
5. Links of balls make components; ids and counts go back to all rows.

Cosines are computed in double precision; a whole-ball decision leaves a
margin for rounding and everything inside the margin is compared.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (n_links 0, their own component); so do rows
with a null id (null component, kept); vectors of different lengths never
link; repeated rows are copies that link with each other; labels and other
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch, arrow_schema, map_batches, to_batch
from hourglass.llm.components import connected_components
from hourglass.llm.kernels import combine, mix
from hourglass.llm.vectors import matrices, packed_vectors, unit

THRESHOLD = 0.9
ROUNDS = 3                  # ball rounds, each a table of two rotations
MISS = 1e-3                 # chance to miss a pair at the threshold
BLOCK_ROWS = 256
MARGIN = 1e-7               # radians
_SEED = 20240607


def parameters(classes: int, dimension: int) -> tuple[int, int, int]:
    """(rotations in a table, probes, tables) for so many classes.

    The chance that a table meets a pair of cosine 0.9 is about 0.52 with 2
    rotations and 4 probes and falls by 0.69 for each further rotation when
    the probes double (measured on random pairs in 64 dimensions). In theory
    each rotation's chance falls as a small power of the dimension; a power of
    0.04 is on the safe side of what is measured from 64 to 1,024 dimensions.
    """
    padded = max(2, 1 << (dimension - 1).bit_length())
    k = max(3, math.ceil(math.log(max(classes, 2), 2 * padded)))
    met = 0.52 * 0.69 ** (k - 2) * min(1.0, (64 / padded) ** (0.04 * k))
    return k, 2 ** k, math.ceil(math.log(MISS) / math.log(1 - met))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, rows padded to a power of two."""
    n = max(2, 1 << (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([_SEED, seed, n]).choice([-1.0, 1.0], size=(3, n))
    x = np.hstack([x, np.zeros((len(x), n - x.shape[1]))]) if n > x.shape[1] else x
    for s in signs:
        x, h = x * s, 1
        while h < n:
            y = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
            h *= 2
        x /= math.sqrt(n)
    return x


def bucket_ids(x: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
    """Rows x (1 + probes) bucket numbers of unit vectors: the own bucket, then the probes of least loss."""
    n, deep = len(x), min(5, probes + 1)
    corner, loss = [], []
    for r in range(k):
        y = rotate(x, table * 64 + r)
        both = np.hstack([-y, y])
        top = np.argpartition(-both, min(deep, both.shape[1] - 1), axis=1)[:, :deep]
        v = np.take_along_axis(both, top, axis=1)
        order = np.argsort(-v, axis=1, kind="stable")
        corner.append(np.take_along_axis(top, order, axis=1))
        v = np.take_along_axis(v, order, axis=1)
        loss.append((v[:, :1] - v) ** 2)
    choices = sorted(product(range(min(deep, corner[0].shape[1])), repeat=k), key=lambda c: (sum(c), c))[:8 * (probes + 1)]
    total = np.stack([sum(loss[r][:, c[r]] for r in range(k)) for c in choices], axis=1)
    best = np.argsort(total, axis=1, kind="stable")[:, :probes + 1]
    picked = np.array(choices)[best]                                          # rows x probes x k
    out = np.full((n, best.shape[1]), table, np.int64).view(np.uint64)
    for r in range(k):
        out = combine(out, np.take_along_axis(corner[r], picked[:, :, r], axis=1).astype(np.uint64))
    return out.view(np.int64)


def _cosines(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Cosines of packed vectors, pair by pair; -2 where the lengths differ."""
    out = np.full(len(a), -2.0)
    same = np.flatnonzero([len(x) == len(y) for x, y in zip(a, b)])
    if len(same):
        for d, (at, x) in matrices([a[i] for i in same]).items():
            y = np.frombuffer(b"".join(b[i] for i in same[at]), np.float64).reshape(-1, d)
            out[same[at]] = np.clip((unit(x) * unit(y)).sum(axis=1), -1, 1)
    return out


def _balls(classes: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """(cls, vec, n, least, ball, angle): the ball of every class and its angle to the pivot."""
    half = math.acos(threshold) / 2 - MARGIN

    def hashed(batch):
        blobs = batch.column("vec").to_pylist()
        ids = np.empty((len(blobs), ROUNDS), np.int64)
        for d, (at, x) in matrices(blobs).items():
            for t in range(ROUNDS):
                ids[at, t] = bucket_ids(unit(x), 1000 + t, 2, 0)[:, 0]
        cols = {c: batch.column(c) for c in ("cls", "vec", "n", "least")}
        return {**cols, **{f"b{t}": mix(ids[:, t].view(np.uint64) + np.array([len(b) for b in blobs], np.uint64)).view(np.int64)
                           for t in range(ROUNDS)}}

    ddl = "cls long, vec binary, n long, least long"
    buckets = ", ".join(f"b{t} long" for t in range(ROUNDS))
    left = scratch.put(map_batches(classes, hashed, f"{ddl}, {buckets}"), "hashed")
    done = None

    def near(batch):
        angle = np.arccos(_cosines(batch.column("vec").to_pylist(), batch.column("pivot_vec").to_pylist()).clip(-1, 1))
        angle[[p == c for p, c in zip(batch.column("ball").to_pylist(), batch.column("cls").to_pylist())]] = 0.0
        keep = np.flatnonzero(angle <= half)
        return {**{c: batch.column(c).take(keep) for c in ("cls", "ball")}, "angle": angle[keep]}

    for t in range(ROUNDS):
        pivots = left.groupBy(f"b{t}").agg(F.min("cls").alias("ball"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
        met = (left.join(pivots, f"b{t}").select("cls", "vec", "ball")
               .join(left.select(F.col("cls").alias("ball"), F.col("vec").alias("pivot_vec")), "ball"))
        taken = scratch.put(map_batches(met.select("cls", "vec", "ball", "pivot_vec"), near, "cls long, ball long, angle double"), "taken")
        # A ball of its pivot alone is no ball yet.
        real = taken.filter(F.col("cls") != F.col("ball")).select("ball").distinct()
        taken = taken.join(real, "ball", "left_semi")
        new = left.join(taken, "cls").select("cls", "vec", "n", "least", "ball", "angle")
        done = new if done is None else done.unionByName(new)
        if t + 1 < ROUNDS:
            left = scratch.put(left.join(taken.select("cls"), "cls", "left_anti"), "left")
        else:
            left = left.join(taken.select("cls"), "cls", "left_anti")
    alone = left.select("cls", "vec", "n", "least", F.col("cls").alias("ball"), F.lit(0.0).alias("angle"))
    return scratch.put(done.unionByName(alone), "balls")


def _candidates(members: DataFrame, scratch: Scratch, n_classes: int, dimension: int) -> DataFrame:
    """(a, b), a < b: balls whose members share a bucket."""
    k, probes, tables = parameters(n_classes, dimension)

    def hashed(batch):
        blobs = batch.column("vec").to_pylist()
        balls = batch.column("ball").to_numpy(zero_copy_only=False)
        parts = []
        for d, (at, x) in matrices(blobs).items():
            x = unit(x)
            for t in range(tables):
                ids = combine(bucket_ids(x, t, k, probes).view(np.uint64), np.uint64(d)).view(np.int64)
                own = np.zeros(ids.shape, np.int8)
                own[:, 0] = 1
                ball = np.repeat(balls[at], ids.shape[1])
                parts.append(np.unique(np.stack([ids.ravel(), ball, own.ravel().astype(np.int64)]), axis=1))
        bucket, ball, own = np.concatenate(parts, axis=1)
        return {"bucket": bucket, "ball": ball, "own": own}

    entries = scratch.put(map_batches(members.select("vec", "ball"), hashed, "bucket long, ball long, own int")
                          .groupBy("bucket", "ball").agg(F.max("own").alias("own")), "entries")
    own, other = entries.filter("own = 1").select("bucket", F.col("ball").alias("a")), entries.select("bucket", F.col("ball").alias("b"))
    pairs = own.join(other, "bucket").filter("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(pairs: DataFrame, members: DataFrame, scratch: Scratch, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links of undecided balls (a, b): (cls, links) counts, and the ball pairs that link."""
    chunks = members.groupBy("ball").agg(F.count(F.lit(1)).alias("size")).select(
        "ball", F.ceil(F.col("size") / BLOCK_ROWS).cast("long").alias("chunks"))
    wanted = pairs.select(F.col("a").alias("ball")).unionByName(pairs.select(F.col("b").alias("ball"))).distinct()
    blocks = scratch.put(members.join(wanted, "ball", "left_semi").join(chunks, "ball")
                         .withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks")).repartition("ball", "chunk")
                         .groupBy("ball", "chunk").agg(F.collect_list(F.struct("cls", "n", "vec")).alias("rows")), "blocks")
    target = arrow_schema("a long, b long, cls long, links long")

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                left, right = batch.column("left")[i].as_py(), batch.column("right")[i].as_py()
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                x, y = (np.stack([np.frombuffer(r["vec"], np.float64) for r in side]) for side in (left, right))
                if x.shape[1] != y.shape[1]:
                    continue
                link = unit(x) @ unit(y).T >= threshold
                for side, own, other in ((left, link, right), (right, link.T, left)):
                    counts = own @ np.array([r["n"] for r in other], np.int64)
                    out += [(a, b, r["cls"], int(c)) for r, c in zip(side, counts) if c]
            yield to_batch(dict(zip(target.names, zip(*out) if out else ([],) * 4)), target)

    left = blocks.select(F.col("ball").alias("a"), F.col("rows").alias("left"))
    right = blocks.select(F.col("ball").alias("b"), F.col("rows").alias("right"))
    found = scratch.put(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
                        .mapInArrow(run, "a long, b long, cls long, links long"), "block-links")
    return found.groupBy("cls").agg(F.sum("links").alias("links")), found.select("a", "b").distinct()


def near_duplicates(table: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``table``."""
    rows = scratch.put(packed_vectors(table, id_col, vector_col), "rows")
    usable = rows.filter(F.col("cls").isNotNull() & F.col("vec_id").isNotNull())
    classes = scratch.put(usable.groupBy("cls").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "classes")
    n_classes, widest = classes.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    members = _balls(classes, scratch, threshold)
    balls = scratch.put(members.groupBy("ball").agg(
        F.max("angle").alias("radius"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.max(F.when(F.col("cls") == F.col("ball"), F.col("vec"))).alias("vec")), "ball-table")
    pairs = _candidates(members, scratch, n_classes, (widest or 8) // 8)
    side = lambda x: balls.select(F.col("ball").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("radius", "n", "vec")])
    limit = math.acos(threshold)

    def decide(batch):
        angle = np.arccos(_cosines(batch.column("vec_a").to_pylist(), batch.column("vec_b").to_pylist()).clip(-1, 1))
        angle[[len(x) != len(y) for x, y in zip(batch.column("vec_a").to_pylist(), batch.column("vec_b").to_pylist())]] = 9.0
        reach = sum(batch.column(f"radius_{x}").to_numpy(zero_copy_only=False) for x in "ab")
        keep = np.flatnonzero(angle - reach <= limit + MARGIN)
        return {**{c: batch.column(c).take(keep) for c in ("a", "b", "n_a", "n_b")}, "whole": (angle + reach <= limit - MARGIN)[keep]}

    decided = scratch.put(map_batches(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "radius_a", "radius_b", "vec_a", "vec_b"),
        decide, "a long, b long, n_a long, n_b long, whole boolean"), "decided")
    whole = decided.filter("whole")
    counts, linked = _block_links(decided.filter("not whole").select("a", "b"), members, scratch, threshold)
    by_ball = (whole.select(F.col("a").alias("ball"), F.col("n_b").alias("links")).unionByName(whole.select(F.col("b").alias("ball"), F.col("n_a").alias("links")))
               .groupBy("ball").agg(F.sum("links").alias("ball_links")))
    parts = connected_components(whole.select("a", "b").unionByName(linked), scratch)
    labelled = balls.join(parts.select(F.col("node").alias("ball"), "component"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ball_info = scratch.put(labelled.join(least, "component").join(by_ball, "ball", "left").select(
        "ball", "component_id", (F.col("n") - 1 + F.coalesce("ball_links", F.lit(0))).alias("ball_links")), "ball-info")
    per_class = (members.select("cls", "ball").join(ball_info, "ball").join(counts, "cls", "left")
                 .select(F.col("cls").alias("of"), "component_id", (F.col("ball_links") + F.coalesce("links", F.lit(0))).alias("n_links")))
    info = scratch.put(per_class, "class-info")
    joined = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("cls")).alias("cls")).join(info, F.col("cls") == info["of"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
