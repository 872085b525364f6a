"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles (of the words between
ASCII white space, A-Z lower-cased); two documents link when
100 * |intersection| >= 80 * |union|. All links between different sets are
kept; equal sets are one class and need no links.

1. Order of shingles. Exact document frequencies over the whole corpus:
   tasks send sorted, packed shingle hashes by hash range, each range counts
   its own. What comes back is bounded: one bit per slot of a fixed bitmap
   (shingles that several documents hold) and the ``hot_kept`` most frequent
   shingles with their frequencies. Order: single shingles, repeated ones,
   then hot ones by frequency. Any order is right; this one is cheap.
2. Prefixes. With overlap o = ceil(0.8 n) a set of n shingles must share at
   least l of its first n - o + l shingles with any set it links to. Every
   document takes the l of least estimated cost (its candidates, which
   shrink with l, and its index rows, which grow). A pair must then share
   ``needed`` shingles of the prefixes, l of the two and more where the
   sizes ask for more. Single shingles match nothing and are not indexed.
3. Pivots. In every posting list the smallest class meets all others; pairs
   with enough shared prefix shingles are verified on whole sets. Classes
   that link are joined, so a large group of near copies is one component
   after as many pairs as it has members.
4. The rest. Posting lists that still hold several components: short ones
   emit their pairs across components; long ones would emit too many, so
   their classes form clusters whose whole sets are compared in blocks of
   bounded size, and only links across components come out.

Hashes are 64-bit; sets are equal when sizes and two 64-bit sums are.

Defined cases: null, empty and white-space texts have an empty set and link
with nothing; fewer than five words make one shingle of the whole sequence;
a row with a null id links with nothing and has a null component; rows with
equal ids are one document where their sets are equal, else each links on
its own and all carry the id; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch, arrow_schema, map_batches, texts_of, to_batch
from hourglass.llm.components import connected_components
from hourglass.llm.kernels import hash_texts, mix, windows

WIDTH = 5
BITMAP_BITS = 27            # the bitmap of repeated shingles: 2^27 bits, 16 MB
RANGES_PER_PARTITION = 4    # hash ranges of the frequency count, rounded up to a power of two
HOT_FROM = 16               # frequencies below it are not told apart
HOT_KEPT = 1 << 19          # hot shingles told apart at most, 12 bytes each
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
LONG_LIST = 32              # classes in a posting list from which it goes by blocks
BLOCK_TOKENS = 400_000      # shingles of a block, 8 bytes each
_KEY_BITS = 48              # of a shingle's hash, for frequencies only


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, first = hash_texts([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    whole = windows(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(whole[a:b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(windows(words[a:b], b - a))
        else:
            out.append(words[:0])
    return out


# --- 1. the order of shingles ------------------------------------------------------


def _pack(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane (high planes are mostly zero)."""
    return np.ascontiguousarray(np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1))


@dataclass
class Order:
    """The broadcast part of the order: which shingles repeat, and how often the hot ones do."""

    bitmap: np.ndarray
    hot: np.ndarray
    hot_df: np.ndarray

    def frequency(self, shingles: np.ndarray) -> np.ndarray:
        """1 for single shingles, 2 for repeated ones, the exact frequency for hot ones."""
        slot = (shingles >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        df = 1 + ((self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(np.int64)
        if len(self.hot):
            many = np.flatnonzero(df > 1)
            key = shingles[many] >> np.uint64(64 - _KEY_BITS)
            at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            hit = self.hot[at] == key
            df[many[hit]] = self.hot_df[at[hit]]
        return df


def corpus_order(docs: DataFrame, text_col: str, hot_kept: int = HOT_KEPT) -> Order:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << min(16, max(4, (RANGES_PER_PARTITION * parts - 1).bit_length()))
    shift = np.uint64(_KEY_BITS - (ranges.bit_length() - 1))

    def send(batch):
        out = {"r": [], "keys": []}
        sets = shingle_sets(texts_of(batch, text_col))
        if sets:
            keys = np.sort(np.concatenate(sets) >> np.uint64(64 - _KEY_BITS))
            cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << shift)
            for r in range(ranges):
                if cuts[r + 1] > cuts[r]:
                    out["r"].append(r)
                    out["keys"].append(_pack(keys[cuts[r]:cuts[r + 1]]))
        return out

    kept = max(1, hot_kept // ranges)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(np.concatenate([_unpack(b) for b in frame["keys"]]))
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        df = np.diff(np.r_[starts, len(keys)])
        keys = keys[starts]
        slot = (keys[df > 1] >> np.uint64(_KEY_BITS - BITMAP_BITS)).astype(np.int64) % (1 << BITMAP_BITS) \
            - int(frame["r"].iloc[0]) * ((1 << BITMAP_BITS) // ranges)
        bits = np.zeros((1 << BITMAP_BITS) // ranges, np.uint8)
        bits[slot] = 1
        hot = np.flatnonzero(df >= HOT_FROM)
        if len(hot) > kept:
            hot = np.sort(hot[np.argsort(-df[hot], kind="stable")[:kept]])
        return pd.DataFrame({"r": [int(frame["r"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()],
                             "hot": [keys[hot].tobytes()], "df": [df[hot].astype(np.uint32).tobytes()]})

    packed = map_batches(docs.select(text_col), send, "r int, keys binary", rows=4000)
    got = {x["r"]: x for x in packed.groupBy("r").applyInPandas(count, "r int, bits binary, hot binary, df binary").collect()}
    blank = bytes((1 << BITMAP_BITS) // ranges // 8)
    join = lambda name, none: b"".join(bytes(got[r][name]) if r in got else none for r in range(ranges))
    return Order(np.frombuffer(join("bits", blank), np.uint8), np.frombuffer(join("hot", b""), np.uint64),
                 np.frombuffer(join("df", b""), np.uint32).astype(np.int64))


# --- 2. adaptive prefixes ------------------------------------------------------------


def choose_prefix(shingles: np.ndarray, df: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(matches asked for, the repeated shingles of the prefix) of least estimated cost.

    With l matches the prefix has n - o + l shingles. Documents that share at
    least l of them are at most the sum of their frequencies over l; every
    repeated shingle is also an index row, which counts as two candidates.
    """
    n = len(shingles)
    if n == 0:
        return 1, shingles
    kind = np.where(df <= 2, df, np.floor(np.log2(np.maximum(df, 2))) + 1)
    order = np.lexsort((shingles, kind))
    ranked = df[order]
    candidates, rows = np.cumsum(np.where(ranked > 1, ranked - 1, 0)), np.cumsum(ranked > 1)
    base = n - -(-percent * n // 100)
    cost = {m: candidates[base + m - 1] / m + 2 * rows[base + m - 1] for m in MATCHES if base + m <= n or m == 1}
    matches = min(cost, key=lambda m: (cost[m], m))
    prefix = order[:base + matches]
    return matches, shingles[prefix[df[prefix] > 1]]


def index_rows(docs: DataFrame, order: Order, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, matches, prefix, shingles) of every document.

    ``shingles`` (the whole set) is null where the prefix has no repeated
    shingle: such a document links with nothing but equal sets.
    """
    shared = docs.sparkSession.sparkContext.broadcast((order.bitmap, order.hot, order.hot_df))
    ddl = (f"doc_id {dict(docs.dtypes)[id_col]}, n long, sig_a long, sig_b long, matches int, "
           "prefix array<long>, shingles binary")

    def run(batch):
        order, out = Order(*shared.value), {k: [] for k in ("n", "sig_a", "sig_b", "matches", "prefix", "shingles")}
        sets = shingle_sets(texts_of(batch, text_col))
        df = np.split(order.frequency(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
        for s, f in zip(sets, df):
            matches, prefix = choose_prefix(s, f, percent)
            for name, v in (("n", len(s)), ("sig_a", int(mix(s).sum(dtype=np.uint64).view(np.int64))),
                            ("sig_b", int(mix(~s).sum(dtype=np.uint64).view(np.int64))), ("matches", matches),
                            ("prefix", prefix.view(np.int64)), ("shingles", s.tobytes() if len(prefix) else None)):
                out[name].append(v)
        return {"doc_id": batch.column(id_col), **out}

    return map_batches(docs.select(id_col, text_col), run, ddl)


# --- 3. and 4. candidates, verification, components -------------------------------------


def _needed(n_a: Column, l_a: Column, n_b: Column, l_b: Column, percent: int) -> Column:
    """Prefix shingles that a linking pair shares at least: the smaller l of the two,
    plus what the pair's overlap asks for beyond the larger set's own least overlap.
    (All shingles up to the end of the prefix that ends first are in both prefixes,
    and that set may miss n - overlap of its own.)"""
    least = F.least(l_a, l_b).cast("long")
    own = lambda n: F.ceil(F.lit(percent) * n / 100)
    pair = F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent))
    return least + pair - F.greatest(own(n_a), own(n_b))


def _sizes_fit(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _pairs_with_enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with columns of both sides, one row per shared prefix shingle, that share enough."""
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *[F.max(x).alias(x) for x in ("n_a", "l_a", "n_b", "l_b")])
    return counted.filter(F.col("c") >= _needed(*[F.col(x) for x in ("n_a", "l_a", "n_b", "l_b")], percent)).select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b"))

    def run(batch):
        a, b = batch.column("set_a"), batch.column("set_b")
        keep = []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        index = np.flatnonzero(keep)
        return {"a": batch.column("a").take(index), "b": batch.column("b").take(index)}

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def link_blocks(x: list[tuple[int, int, np.ndarray]], y: list[tuple[int, int, np.ndarray]], percent: int
                ) -> list[tuple[int, int]]:
    """Links across components between two blocks of (class, component, set).

    The common shingles of the blocks are columns of 0/1 matrices, taken a
    few thousand at a time; their product counts every pair's intersection.
    Of the links only a spanning forest over the components is returned.
    """
    tokens = np.concatenate([s for _, _, s in x] + ([s for _, _, s in y] if y is not x else []))
    uniq, count = np.unique(tokens, return_counts=True)
    uniq = uniq[count > 1]
    common = np.zeros((len(x), len(y)), np.float32)
    step = 4096
    ids = [[np.searchsorted(uniq, s[np.isin(s, uniq, assume_unique=True)]) for _, _, s in side] for side in (x, y)]
    for start in range(0, len(uniq), step):
        m = []
        for side, own in zip((x, y), ids):
            block = np.zeros((len(side), step), np.float32)
            for i, at in enumerate(own):
                block[i, at[(at >= start) & (at < start + step)] - start] = 1
            m.append(block)
        common += m[0] @ m[1].T
    n_x, n_y = np.array([len(s) for _, _, s in x]), np.array([len(s) for _, _, s in y])
    comp_x, comp_y = np.array([c for _, c, _ in x]), np.array([c for _, c, _ in y])
    link = (100 * common >= percent * (n_x[:, None] + n_y[None, :] - common)) & (comp_x[:, None] != comp_y[None, :])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(link)):
        a, b = find(int(comp_x[i])), find(int(comp_y[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x[i][0], y[j][0]))
    return out


def _cluster_links(members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links across components inside clusters; members: (cluster, cid, comp, n, shingles)."""
    totals = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    dealt = members.join(totals.select("cluster", F.ceil(F.col("total") / BLOCK_TOKENS).cast("long").alias("blocks")), "cluster")
    # Dealt anew: grouping the rows where the join left them would build all blocks of a cluster in one task.
    blocks = scratch.put(dealt.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).repartition("cluster", "block")
                         .groupBy("cluster", "block").agg(F.max("blocks").alias("blocks"),
                                                          F.collect_list(F.struct("cid", "comp", "shingles")).alias("rows")), "blocks")
    first = blocks.select("cluster", F.col("block").alias("i"), F.col("rows").alias("rows_i"),
                          F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    second = blocks.select("cluster", F.col("block").alias("j"), F.col("rows").alias("rows_j"))
    target = arrow_schema("a long, b long")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                side = [[(r["cid"], r["comp"], np.frombuffer(r["shingles"], np.uint64)) for r in batch.column(c)[k].as_py()]
                        for c in ("rows_i", "rows_j")]
                same = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                links = link_blocks(side[0], side[0] if same else side[1], percent)
                yield to_batch({"a": [a for a, _ in links], "b": [b for _, b in links]}, target)

    return (first.join(second, ["cluster", "j"]).select("cluster", "i", "j", "rows_i", "rows_j")
            .mapInArrow(run, "a long, b long"))


def jaccard_components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                       percent: int = 80, hot_kept: int = HOT_KEPT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    order = corpus_order(docs, text_col, hot_kept)
    rows = scratch.put(index_rows(docs, order, id_col, text_col, percent), "rows")
    signature = ["n", "sig_a", "sig_b"]
    classes = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*signature).agg(F.min("doc_id").alias("cid"))
    reps = scratch.put(rows.filter(F.col("shingles").isNotNull())
                       .join(classes, (rows.doc_id == classes.cid) & (rows.n == classes.n)
                             & (rows.sig_a == classes.sig_a) & (rows.sig_b == classes.sig_b), "left_semi")
                       .select(F.xxhash64("sig_a", "sig_b", "n", "doc_id").alias("cid"), "doc_id", F.col("n"), "matches", "prefix", "shingles"),
                       "reps")
    postings = reps.select(F.explode("prefix").alias("token"), "cid", "n", F.col("matches").alias("l"))
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("cid", "n", "l")).alias("pivot")).filter("size > 1")
    postings = scratch.put(postings.join(lists, "token"), "postings")

    def side_by_side(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("x.cid").alias("a"), F.col("x.n").alias("n_a"), F.col("x.l").alias("l_a"),
                            F.col("y.cid").alias("b"), F.col("y.n").alias("n_b"), F.col("y.l").alias("l_b"))

    with_pivot = postings.filter((F.col("cid") != F.col("pivot.cid")) & _sizes_fit(F.col("n"), F.col("pivot.n"), percent)).select(
        F.col("pivot.cid").alias("a"), F.col("pivot.n").alias("n_a"), F.col("pivot.l").alias("l_a"),
        F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("l").alias("l_b"))
    sets = reps.select("cid", "shingles")
    links = scratch.put(_verify(_pairs_with_enough(with_pivot, percent), sets, percent), "pivot-links")
    joined = connected_components(links, scratch)
    # Lists that still hold several components.
    held = postings.join(joined, postings.cid == joined.node, "left").select(
        "token", "cid", "n", "l", "size", F.coalesce("component", "cid").alias("comp"))
    spread = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cid").alias("first")).filter("lo < hi")
    open_ = scratch.put(held.join(spread.select("token", "first"), "token"), "open")
    short = open_.filter(F.col("size") < LONG_LIST).drop("size", "first")
    across = side_by_side(short.alias("x").join(short.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") < F.col("y.cid"))
                                                & (F.col("x.comp") != F.col("y.comp")) & _sizes_fit(F.col("x.n"), F.col("y.n"), percent)))
    links_2 = scratch.put(_verify(_pairs_with_enough(across, percent), sets, percent), "short-links")
    long_ = open_.filter(F.col("size") >= LONG_LIST)
    clusters = connected_components(long_.select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct(), scratch)
    in_cluster = (clusters.select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
                  .join(long_.select("cid", "comp").distinct(), "cid").join(reps.select("cid", "n", "shingles"), "cid"))
    links_3 = scratch.put(_cluster_links(in_cluster, scratch, percent), "block-links")
    # Components of classes by their documents' smallest ids.
    parts = connected_components(links.unionByName(links_2).unionByName(links_3), scratch)
    named = parts.join(reps.select(F.col("cid").alias("node"), "doc_id"), "node")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = scratch.put(named.join(smallest, "component").select("node", "component_id"), "classes")
    known = (classes.withColumn("node", F.xxhash64("sig_a", "sig_b", "n", "cid")).join(by_class, "node", "left")
             .select(*signature, F.coalesce("component_id", "cid").alias("component_id")))
    return (rows.join(known, signature, "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id")))


def keep_one_per_component(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                           percent: int = 80) -> DataFrame:
    """The rows of each component's smallest id, with all their columns; rows with a null id stay."""
    found = jaccard_components(docs, scratch, id_col, text_col, percent)
    gone = scratch.put(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return docs.join(gone, id_col, "left_anti")
