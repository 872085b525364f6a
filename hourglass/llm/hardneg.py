"""Hard-negative mining by threshold joins over an inverted index with norm bounds.

Vectors become integers, floor(scale * x); a score is their inner product. An
anchor's positives are its best other rows of the same label; a positive's
negatives are the best rows of other labels whose score lies in a window of
shares of the positive's score.

Rows are dealt to blocks by the hash of their id; each anchor meets each block
(a stated query set against all rows, in blocks), unless the block's largest
norm rules it out. A task gets one block's rows and after them its anchors, in
one stream by the block's number: what meets is never a join's side, so neither
the driver nor a task holds more than a block and a pack. The task joins each
pack of anchors with the block, tile by tile, under the anchors' thresholds.
Dimensions go in order of falling energy, by groups.

* Index: a row's last groups stay out of the lists where the norm of the
  row's suffix times the largest suffix norm of the pack is below every
  threshold: what they could add never lifts a pair over it alone. Rows are
  sorted by the number of groups listed, so the list of a group is a prefix of
  the rows, and a row without any is never looked at.
* Scores build up group by group over the lists. After a group a pair stays
  only if its part and the product of the remaining norms reach the anchor's
  threshold; rows that no anchor needs leave the lists. Where few leave, twice
  as many groups go by until they are looked at again.
* What is left is verified by the exact integer product. A task returns, for
  each anchor (or window), at most as many rows of its block as are asked for.

Thresholds start where a bounded sample (``SAMPLE_ROWS`` rows of smallest
hash) expects enough rows, and are lowered for the anchors whose windows are
not full, to the window's lower end (for positives: to none) in the last
round, so the sample sets the work and never the answer.

Defined cases: rows with a null id, label or vector, an empty vector, or a
null or non-finite component take no part, nor do rows with a component
beyond 2^26 after scaling (64-bit scores could overflow); rows that repeat an
id count once, the least by label, then by vector; vectors of different
dimensions are not compared; zero vectors score 0; equal scores go by id; an
anchor without other rows of its label has no rows, as has a positive with a
negative score (its window is empty); empty tables give no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch, arrow_schema, map_batches, release_memory, to_batch

BLOCK_BYTES = 8 << 20        # most of a block's vectors, about
BLOCKS = 64                  # wanted at least, as long as a block then has
BLOCK_ROWS = 2048            # so many rows
TILE_ROWS = 512              # rows and anchors joined at a time
PACK_ROWS = 256
GROUP = 8                    # dimensions of a list
SAMPLE_ROWS = 1024
SPARE = 4                    # times the rows asked for that the first threshold should leave
LIMIT = 1 << 26
NO_THRESHOLD = -(1 << 62)
ROUNDS = 3


def integer_rows(table: DataFrame, anchor: Column, label: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, label, anchor, q, norm): the usable rows once each, q the integer vector as 32-bit integers."""
    def run(batch):
        kept, q, norm = [], [], []
        for i, v in enumerate(batch.column("v").to_pylist()):
            if not v or any(c is None for c in v):
                continue
            x = np.floor(scale * np.array(v, np.float64))
            if np.isfinite(x).all() and np.abs(x).max() <= LIMIT:
                kept.append(i)
                q.append(x.astype("<i4").tobytes())
                norm.append(float(np.sqrt((x * x).sum())))
        return {**{c: batch.column(c).take(np.array(kept, np.int64)) for c in ("vec_id", "label", "anchor")}, "q": q, "norm": norm}

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.coalesce(anchor, F.lit(False)).alias("anchor"),
                        F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and label is not null")
    found = map_batches(rows, run, "vec_id long, label long, anchor boolean, q binary, norm double")
    return (found.groupBy("vec_id").agg(F.min(F.struct("label", "q", "anchor", "norm")).alias("x"))
            .select("vec_id", "x.label", "x.anchor", "x.q", "x.norm"))


def _matrices(rows: list[dict]) -> dict[int, tuple[list[dict], np.ndarray]]:
    """Rows by dimension, with their integer matrix."""
    by: dict[int, list[dict]] = {}
    for r in rows:
        by.setdefault(len(r["q"]) // 4, []).append(r)
    return {d: (x, np.frombuffer(b"".join(r["q"] for r in x), "<i4").reshape(-1, d).astype(np.int64)) for d, x in by.items()}


def _suffix_norms(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norms of the rows from each cut on; the last cut is the end."""
    power = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.c_[power, np.zeros(len(x))][:, cuts])


def _prepared(x: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integer rows, their components in order as doubles, the norms from each group on, and where the groups begin."""
    cuts = np.r_[np.arange(0, x.shape[1], GROUP), x.shape[1]]
    ordered = x[:, order].astype(np.float64)
    return x, ordered, _suffix_norms(ordered, cuts), cuts


def threshold_join(q: np.ndarray, x: np.ndarray, least: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with score >= the anchor's threshold, from the lists of groups of dimensions."""
    return _join(_prepared(q, order), _prepared(x, order), least, lambda i, j: np.ones(len(i), bool))


def _join(left: tuple, right: tuple, least: np.ndarray, asked: Callable[[np.ndarray, np.ndarray], np.ndarray]
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``threshold_join`` of prepared sides, of the pairs ``asked`` for."""
    (q, a, rest_a, cuts), (x, b, rest_b, _) = left, right
    slack = 1e-9 * rest_a[:, 0]                               # times the row's norm, and 1
    # The lists: groups before the first cut from which on no threshold can be reached by the suffix alone.
    short = rest_b * rest_a.max(axis=0) + (slack.max() * rest_b[:, :1] + 1) < least.min()
    listed = np.where(short.any(axis=1), short.argmax(axis=1), len(cuts) - 1)
    rows = np.argsort(-listed, kind="stable")
    rows = rows[listed[rows] > 0]
    part, b = np.zeros((len(rows), len(a))), b[rows]
    room = np.empty_like(part)

    def reach(of, to):
        """What the scores of the rows can still reach from a cut on, over the thresholds: a sum of three products by row and anchor."""
        sides = np.c_[rest_b[rows[of], to], rest_b[rows[of], 0], np.ones(len(rows[of]))], np.c_[rest_a[:, to], slack, 1.0 - least]
        return np.add(np.matmul(sides[0], sides[1].T, out=room[of]), part[of], out=room[of])

    g, last, step = 0, len(cuts) - 1, 1
    while g < last:
        n = int(np.searchsorted(-listed[rows], -g))           # rows whose list holds the group come first
        if not n:
            break
        start, g = g, min(g + step, last)
        listed[rows[:n]] = np.maximum(listed[rows[:n]], g)    # a list that ends on the way goes on to the next look
        dims = slice(cuts[start], cuts[g])
        part[:n] += np.matmul(b[:n, dims], a[:, dims].T, out=room[:n])
        if g == last:
            break
        alive = reach(slice(0, n), g).max(axis=1) >= 0
        step *= 2
        if alive.mean() < 0.8:
            stay = np.r_[np.flatnonzero(alive), np.arange(n, len(rows))]
            rows, part, b, step = rows[stay], part[stay], b[stay], 1
    end = listed[rows]
    edge = np.flatnonzero(np.diff(end)) + 1
    for of in (slice(s, e) for s, e in zip(np.r_[0, edge], np.r_[edge, len(rows)]) if s < e):
        reach(of, end[of.start])
    j, i = np.nonzero(room[:len(rows)] >= 0)
    j = rows[j]
    wanted = asked(i, j)
    i, j = i[wanted], j[wanted]
    score = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        score[s] = np.einsum("ij,ij->i", q[i[s]], x[j[s]])
    hit = score >= least[i]
    return i[hit], j[hit], score[hit]


def _first(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of every anchor: score falling, id rising."""
    place = np.lexsort((ids, -score, i))
    own = i[place]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return place[rank < k]


def _blocks(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of their block; (block, block_norm) of every block."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.length("q"))).first()
    count = max(1, -(-(size or 0) // BLOCK_BYTES), min(BLOCKS, -(-n // BLOCK_ROWS)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    return dealt, scratch.put(dealt.groupBy("block").agg(F.max("norm").alias("block_norm")), "norms")


class _Block:
    """A block's rows as they come; of every dimension ids, labels and prepared tiles."""

    def __init__(self):
        self.parts: list[dict] = []
        self.sides: dict[int, list[tuple]] | None = None

    def tiles(self, d: int, order: np.ndarray) -> list[tuple]:
        if self.sides is None:
            self.sides = {}
            for part in self.parts:
                for size, (at, x) in _by_dimension(part["q"]).items():
                    for s in (slice(k, k + TILE_ROWS) for k in range(0, len(at), TILE_ROWS)):
                        self.sides.setdefault(size, []).append((part["vec_id"][at[s]], part["label"][at[s]], x[s]))
            self.parts = []
        found = self.sides.get(d, [])
        for n, (ids, labels, x) in enumerate(found):
            if not isinstance(x, tuple):
                found[n] = ids, labels, _prepared(x, order)
        return found


def _by_dimension(q: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Packed vectors by dimension: their places and their integer matrix."""
    sizes = pc.binary_length(q).to_numpy(zero_copy_only=False) // 4
    out = {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out[int(d)] = at, np.frombuffer(b"".join(q.take(pa.array(at)).to_pylist()), "<i4").reshape(-1, int(d)).astype(np.int64)
    return out


def _windows(column: pa.Array) -> dict[str, np.ndarray]:
    """Windows of anchors as matrices (anchor, n-th window); none: low 1, high 0."""
    ends = column.offsets.to_numpy()
    counts = np.diff(ends)
    row, nth = np.repeat(np.arange(len(counts)), counts), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], counts)
    out = {}
    for name, none in (("positive", 0), ("low", 1), ("high", 0)):
        out[name] = np.full((len(counts), int(counts.max(initial=0))), none, np.int64)
        out[name][row, nth] = column.values.field(name).to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    return out


FOUND = "anchor_id long, positive_id long, vec_id long, score long"
NO_WINDOWS = "array<struct<positive:long,low:long,high:long>>"


def _round(anchors: DataFrame, rows: DataFrame, norms: DataFrame, orders: dict[int, np.ndarray], scratch: Scratch,
           positives: bool, k: int) -> DataFrame:
    """The k best rows of every anchor's label (``positives``) or window, of all rows at or over its threshold;
    anchors: (vec_id, label, q, norm, least, windows)."""
    target = arrow_schema(FOUND)

    def pack(own: dict, block: _Block, d: int, q: np.ndarray):
        """Of anchors of one dimension: (anchor, positive, row, score) in the block."""
        left, found = _prepared(q, orders[d]), []
        for ids, labels, right in block.tiles(d, orders[d]):
            def asked(i, j):
                if positives:
                    return (labels[j] == own["label"][i]) & (ids[j] != own["vec_id"][i])
                return labels[j] != own["label"][i]

            i, j, score = _join(left, right, own["least"], asked)
            if positives:
                best = _first(i, ids[j], score, k)
                found.append((0, i[best], ids[j[best]], score[best]))
                continue
            for w in range(own["low"].shape[1]):
                inside = np.flatnonzero((score >= own["low"][i, w]) & (score <= own["high"][i, w]))
                best = inside[_first(i[inside], ids[j[inside]], score[inside], k)]
                found.append((w, i[best], ids[j[best]], score[best]))
        for w in sorted({f[0] for f in found}):
            i, ids, score = (np.concatenate(c) for c in zip(*(f[1:] for f in found if f[0] == w)))
            best = _first(i, ids, score, k)
            yield own["vec_id"][i[best]], np.full(len(best), -1) if positives else own["positive"][i[best], w], ids[best], score[best]

    def run(batches):
        block, number = _Block(), None
        for batch in batches:
            places = batch.column("block").to_numpy()
            edge = np.flatnonzero((np.diff(places) != 0) | (np.diff(batch.column("kind").to_numpy()) != 0)) + 1
            for start, end in zip(np.r_[0, edge], np.r_[edge, batch.num_rows]):
                if start == end:
                    continue
                if places[start] != number:
                    block, number = _Block(), places[start]
                part = batch.slice(start, end - start)
                own = {c: part.column(c).to_numpy() for c in ("vec_id", "label")}
                if part.column("kind")[0].as_py() == 0:
                    block.parts.append({**own, "q": part.column("q")})
                    continue
                own |= {"least": part.column("least").to_numpy(zero_copy_only=False), **_windows(part.column("windows"))}
                for d, (at, q) in _by_dimension(part.column("q")).items():
                    for s in (slice(n, n + PACK_ROWS) for n in range(0, len(at), PACK_ROWS)):
                        parts = list(pack({c: v[at[s]] for c, v in own.items()}, block, d, q[s]))
                        if parts:
                            yield to_batch(dict(zip(target.names, (np.concatenate(c) for c in zip(*parts)))), target)
        release_memory()

    met = (anchors.crossJoin(F.broadcast(norms)).filter(F.col("norm") * F.col("block_norm") * (1 + 1e-9) + 1 >= F.col("least"))
           .select("block", F.lit(1).alias("kind"), "vec_id", "label", "q", "least", "windows"))
    fed = (rows.select("block", F.lit(0).alias("kind"), "vec_id", "label", "q", F.lit(0).cast("long").alias("least"),
                       F.array().cast(NO_WINDOWS).alias("windows")).unionByName(met))
    count = norms.count()
    found = fed.repartitionById(max(count, 1), F.col("block")).sortWithinPartitions("block", "kind", "least").mapInArrow(run, FOUND)
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return scratch.put(found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k), "found")


def _sampled(rows: DataFrame, total: int) -> list[dict]:
    """At most ``SAMPLE_ROWS`` rows of smallest hash. Tasks send about twice as many in all, whatever their number:
    the hash is uniform, so the rest is left out before the order."""
    if total > 2 * SAMPLE_ROWS:
        rows = rows.filter(F.xxhash64("vec_id") < F.lit(2 * SAMPLE_ROWS * (1 << 64) // total - (1 << 63)))
    return [r.asDict() for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "label", "q").collect()]


def _dimension_orders(rows: DataFrame) -> dict[int, np.ndarray]:
    """The dimensions by falling energy over all rows, for every vector length."""
    def run(batch):
        out = {"d": [], "at": [], "e": []}
        for d, (_, m) in _matrices(batch.select(["q"]).to_pylist()).items():
            out["d"] += [d] * d
            out["at"] += range(d)
            out["e"] += (m.astype(float) ** 2).sum(axis=0).tolist()
        return out

    energy: dict[int, list] = {}
    for r in map_batches(rows.select("q"), run, "d int, at int, e double").groupBy("d", "at").agg(F.sum("e").alias("e")).collect():
        energy.setdefault(r["d"], []).append((-r["e"], r["at"]))
    return {d: np.array([at for _, at in sorted(x)]) for d, x in energy.items()}


def find_positives(anchors: DataFrame, rows: DataFrame, norms: DataFrame, orders: dict, scratch: Scratch, k: int) -> DataFrame:
    """(anchor_id, vec_id, score, rank): the k best other rows of the anchor's label."""
    total = rows.count()
    sample = _matrices(_sampled(rows, total))
    sample = {d: (np.array([r["label"] for r in x]), m) for d, (x, m) in sample.items()}

    def guess(batch):
        """The score that about SPARE * k rows of the label reach, were scores normal; and one by one deviation lower."""
        out = []
        for r in batch.to_pylist():
            labels, m = sample.get(len(r["q"]) // 4, (np.zeros(0), np.zeros((0, len(r["q"]) // 4), np.int64)))
            own = labels == r["label"]
            score = (m[own] if own.sum() >= 8 else m) @ np.frombuffer(r["q"], "<i4").astype(np.int64)
            wanted = SPARE * k / max(total * max(own.mean() if len(own) else 0, 1 / max(len(own), 1)), 1)
            if len(score) < 8 or wanted >= 0.5:
                out.append([NO_THRESHOLD] * 2)
            else:
                z = NormalDist().inv_cdf(1 - wanted)
                out.append([int(score.mean() + s * score.std()) for s in (z, z - 1)])
        return {**{c: batch.column(c) for c in ("vec_id", "label", "q", "norm")}, "guess": out}

    todo = scratch.put(map_batches(anchors, guess, "vec_id long, label long, q binary, norm double, guess array<long>"), "anchors")
    none = F.array().cast(NO_WINDOWS)
    found = []
    for level in range(ROUNDS):
        least = F.lit(NO_THRESHOLD) if level == ROUNDS - 1 else F.col("guess")[level]
        got = _round(todo.select("vec_id", "label", "q", "norm", least.alias("least"), none.alias("windows")), rows, norms, orders, scratch, True, k)
        full = got.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"))
        state = todo.join(full.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
        done = (F.coalesce("n", F.lit(0)) >= k) | (least == NO_THRESHOLD)
        found.append(got.join(state.filter(done).select(F.col("vec_id").alias("anchor_id")), "anchor_id", "left_semi"))
        todo = scratch.put(state.filter(~done).select("vec_id", "label", "q", "norm", "guess"), "open")
        if todo.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return scratch.put(out.select("anchor_id", "vec_id", "score", "rank"), "positives")


def find_negatives(anchors: DataFrame, windows: DataFrame, rows: DataFrame, norms: DataFrame, orders: dict, scratch: Scratch,
                   k: int) -> DataFrame:
    """The k best rows of other labels in every window; windows: (anchor_id, positive_id, low, high)."""
    todo, found = windows, []
    for level in range(ROUNDS):
        down = (0.8, 0.4, 0.0)[level]
        start = (F.col("low") + F.floor((F.col("high") - F.col("low")) * down)).cast("long")
        grouped = todo.groupBy("anchor_id").agg(
            F.min(start).alias("least"), F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("positive"), "low", "high"))).alias("windows"))
        asked = scratch.put(anchors.join(grouped, anchors.vec_id == grouped.anchor_id).select("vec_id", "label", "q", "norm", "least", "windows"), "asked")
        if asked.isEmpty():
            break
        got = _round(asked, rows, norms, orders, scratch, False, k)
        full = got.groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("n"))
        state = todo.join(full, ["anchor_id", "positive_id"], "left").join(asked.select(F.col("vec_id").alias("anchor_id"), "least"), "anchor_id")
        done = (F.coalesce("n", F.lit(0)) >= k) | (F.col("least") <= F.col("low"))
        found.append(got.join(state.filter(done).select("anchor_id", "positive_id"), ["anchor_id", "positive_id"], "left_semi"))
        todo = scratch.put(state.filter(~done).select(*windows.columns), "open")
    if not found:
        return windows.select("anchor_id", "positive_id", F.lit(0).alias("rank"), F.col("positive_id").alias("negative_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "score")


def mine(table: DataFrame, anchor: Column, scratch: Scratch, label: Column | None = None, id_col: str = "vec_id",
         vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``low`` and ``high`` in hundredths."""
    label = F.col("label") if label is None else label
    rows = scratch.put(integer_rows(table, anchor, label, id_col, vector_col, scale), "rows")
    anchors = rows.filter("anchor").select("vec_id", "label", "q", "norm")
    rows, norms = _blocks(rows, scratch)
    orders = _dimension_orders(rows)
    best = find_positives(anchors, rows, norms, orders, scratch, positives)
    score = F.col("score")
    windows = scratch.put(best.select("anchor_id", F.col("vec_id").alias("positive_id"), score.alias("positive_score"),
                                      F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)").alias("low"),
                                      F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("high"))
                          .filter("low <= high"), "windows")
    found = find_negatives(anchors, windows.select("anchor_id", "positive_id", "low", "high"), rows, norms, orders, scratch, negatives)
    return (found.join(windows.select("anchor_id", "positive_id", "positive_score"), ["anchor_id", "positive_id"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")))
