"""Hard negatives, lexical search and suffix merge against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.llm import hardneg, lexical, suffixes

from .conftest import HARD, LONG, docs_frame

# --- lexical search ---------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """docs: (id, text); items: {id: set of terms}."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, b in bags for t in b)
    out = set()
    for item, asked in items.items():
        scored = []
        for (i, b), n in zip(bags, sizes):
            if n:
                m = 10 + (90 * n * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 8 * m)) for t in asked if b[t])
                if s > 0:
                    scored.append((-s, i is None, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


def test_lexical_equals_brute_force(spark, scratch):
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.7)) % 400}" for _ in range(3000)] + ["Éa", "日本", "X9", "x9"]
    docs = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ".", "-", "\x01"]) for _ in range(rnd.randint(0, 40)))) for i in range(20, 320)]
    docs += [(900 + i, "same words here w1 w2 w3") for i in range(30)] + HARD
    items = [(1, "w1 w2 w3 same"), (2, None), (3, "..."), (4, "nowhere"), (5, "X9 日本 w7"), (5, "w8"), (None, "w11 one"), (6, LONG[:2000])]
    items += [(10 + i, " ".join(rnd.choice(words) for _ in range(12))) for i in range(20)]
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("terms", F.lit(0))
    for k in (3, 10):
        got = lexical.rank_documents(docs_frame(spark, docs, extra=True), frame, scratch, k)
        assert {tuple(r) for r in got.collect()} == ranked(docs, asked, k)


def test_lexical_empty_tables(spark, scratch):
    none, some = docs_frame(spark, []), docs_frame(spark, HARD)
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.rank_documents(none, items, scratch).count() == 0
    assert lexical.rank_documents(some, items.limit(0), scratch).count() == 0


def test_tree_shares_paths_and_bounds_hold():
    rnd = np.random.default_rng(4)
    n, n_terms = 700, 60
    bags = [np.unique((rnd.pareto(0.6, rnd.integers(0, 20)) * 2).astype(int) % n_terms) for _ in range(n)]
    tfs = [rnd.integers(1, 9, len(b)) for b in bags]
    m = rnd.integers(10, 300, n)
    offsets = np.r_[0, np.cumsum([len(b) for b in bags])]
    tree = lexical.Tree(np.arange(n), m, offsets, np.concatenate(bags), np.concatenate(tfs), n_terms)
    assert 1 < len(tree.start) < n
    for node, below in enumerate(tree.children):
        if below:
            assert tree.start[node] == tree.start[below[0]] and tree.end[node] == tree.end[below[-1]]
            assert all(tree.end[a] == tree.start[b] for a, b in zip(below, below[1:]))
        own = range(tree.start[node], tree.end[node])
        assert tree.least[node] <= min(tree.m[i] for i in own)
    weights = rnd.integers(1, 9000, n_terms)
    for _ in range(40):
        asked = np.unique(rnd.integers(0, n_terms, 6))
        dense = np.zeros(n_terms, np.int64)
        dense[asked] = weights[asked]
        score = [sum(int(dense[t]) * ((10 ** 9 * int(x)) // (1000 * int(x) + 8 * int(m[i]))) for t, x in zip(bags[i], tfs[i])) for i in range(n)]
        want = sorted(((s, i) for i, s in enumerate(score) if s), key=lambda x: (-x[0], x[1]))[:7]
        assert tree.search(asked, weights[asked], dense, [], 7) == want


# --- hard negatives ------------------------------------------------------------------


def mined(rows, step=10):
    """rows: (id, vector, label), usable ones with unique ids."""
    q = {i: (np.floor(256 * np.array(v, float)).astype(int), l) for i, v, l in rows}
    out = set()
    for a, (x, label) in q.items():
        if a % step:
            continue
        scored = sorted(((-int(x @ y), i, l) for i, (y, l) in q.items() if i != a and len(y) == len(x)))
        for p, i, l in [s for s in scored if s[2] == label][:5]:
            fit = [(j, -s) for s, j, m in scored if m != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out |= {(a, i, r + 1, j, -p, s) for r, (j, s) in enumerate(fit)}
    return out


def test_hard_negatives_equal_brute_force(spark, scratch):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 24))
    vectors = [(i, (centres[i % 6] + rnd.normal(size=24) * rnd.choice([0.2, 1.5])).tolist(), int(rnd.integers(0, 4))) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1], int(i % 4)) for i in range(60)]                      # ties: one vector, many ids
    vectors += [(2000, [0.0] * 24, 1), (2010, [0.0] * 24, 1), (2020, [-0.001] * 24, 2), (2030, [1.0, 2.0], 1), (2040, [1.5, 2.0], 1),
                (2050, [1.0, 1.9], 2), (2060, [2.0] * 24, 99)]
    hard = [(None, vectors[1][1], 1), (3000, None, 1), (3010, [], 1), (3020, [None] + [1.0] * 23, 1), (3030, [float("nan")] * 24, 1),
            (3040, [float("inf")] * 24, 1), (3050, vectors[2][1], None), (3060, [1e30] * 24, 1), vectors[7], vectors[7]]
    df = (spark.createDataFrame(vectors + hard, "vec_id long, embedding array<double>, label int")
          .withColumn("score", F.lit("x")).withColumn("rank", F.lit("y")).withColumn("anchor_id", F.lit(1)))
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0, scratch)
    assert {tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()} == mined(vectors)
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 10 == 0, scratch).count() == 0
    assert hardneg.mine(df, F.lit(False), scratch).count() == 0


class SeenScratch(hardneg.Scratch):
    """Keeps the column types that the planned broadcasts of written frames send through the driver, by the frame's name."""

    def put(self, df, name="t"):
        plan = df._jdf.queryExecution().executedPlan()
        nodes = [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
        for node in nodes:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName().startswith("BroadcastExchange"):
                types = [node.output().apply(i).dataType().catalogString() for i in range(node.output().size())]
                self.seen.setdefault(name, []).append(types)
        return super().put(df, name)


def test_hard_negatives_send_no_vectors_through_the_driver(spark, monkeypatch):
    """Blocks and packs meet without a broadcast of rows: packs repeated for every block are planned by their size on disk."""
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hardneg, "PACK_ROWS", 7)
    monkeypatch.setattr(hardneg, "TILE_ROWS", 5, raising=False)
    rnd = np.random.default_rng(7)
    vectors = [(i, rnd.normal(size=9 if i % 3 else 20).tolist(), int(rnd.integers(0, 3))) for i in range(300)]
    vectors += [(400 + i, vectors[10][1], int(i % 3)) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    scratch = SeenScratch(spark, "test")
    scratch.seen = {}
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0, scratch)
    assert {tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()} == mined(vectors)
    sent = [t for types in scratch.seen.get("found", []) for t in types]
    assert not [t for t in sent if t == "binary" or t.startswith("array")]


def test_hard_negatives_sample_holds_the_smallest_hashes(spark):
    rows = spark.range(30_000).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.lit(b"").alias("q"))
    got = [r["vec_id"] for r in hardneg._sampled(rows, 30_000)]
    want = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(hardneg.SAMPLE_ROWS).collect()
    assert got == [r["vec_id"] for r in want]


def test_threshold_join_loses_no_pair_and_leaves_dimensions_out():
    rnd = np.random.default_rng(6)
    x = (rnd.normal(size=(300, 37)) * np.linspace(90, 1, 37)).astype(np.int64)
    q, order = x[:20], np.argsort(-(x.astype(float) ** 2).sum(axis=0))
    full = q @ x.T
    for least in (-(1 << 62), 0, 10_000, 60_000, 10 ** 7):
        limit = np.full(20, least) + rnd.integers(0, 5, 20)
        i, j, score = hardneg.threshold_join(q, x, limit, order)
        want = {(a, b) for a, b in zip(*np.nonzero(full >= limit[:, None]))}
        assert set(zip(i.tolist(), j.tolist())) == want and (score == full[i, j]).all()


# --- suffix merge ------------------------------------------------------------------------


def without_repeats(texts, length):
    where = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where[t[p:p + length]].append((i, p))
    covered = [bytearray(len(t)) for t in texts]
    for found in where.values():
        if len(found) > 1:
            for i, p in found:
                covered[i][p:p + length] = b"\1" * length
    kept = [bytes(b for b, x in zip(t, c) if not x) for t, c in zip(texts, covered)]
    spans = [sum(c[k] and not (k and c[k - 1]) for k in range(len(c))) for c in covered]
    return [(len(t), sum(c), s, hashlib.sha256(k).hexdigest()) for t, c, s, k in zip(texts, covered, spans, kept)]


def pasted(rnd, count):
    base = ["".join(rnd.choice("abcdefgh  é") for _ in range(rnd.randint(5, 300))) for _ in range(30)]
    out = []
    for _ in range(count):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            b = rnd.choice(base)
            x = rnd.randint(0, len(b))
            t += b[x:rnd.randint(x, len(b))] + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30)))
        out.append(t + "a" * rnd.choice([0, 0, 0, 150]) + "xyz\0" * rnd.choice([0, 0, 0, 40]))
    return out


@pytest.mark.parametrize("length,most_kinds", [(20, 2000), (20, 3), (50, 2000)])
def test_suffix_merge_equals_brute_force(spark, scratch, length, most_kinds):
    rnd = random.Random(length + most_kinds)
    texts = pasted(rnd, 120)
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[4]), (None, texts[5]), (None, None), (777, ""), (778, "a" * 700), (779, "\0" * 90 + "q")]
    want = collections.Counter(zip([i for i, _ in rows], without_repeats([(t or "").encode() for _, t in rows], length)))
    got = suffixes.remove_repeated_bytes(docs_frame(spark, rows, extra=True), scratch, length, most_kinds=most_kinds)
    assert collections.Counter((r[0], tuple(r[1:])) for r in got.collect()) == want


def test_suffix_merge_planted_passages(spark, scratch):
    """Passages of over 50 words in two documents each: 400 bytes decide, not words; ``n_bytes`` is the same either way."""
    rnd = random.Random(13)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, size = [], {}
    for k in range(40):
        passage = " ".join(word(rnd.randint(2, 6) if k % 2 else rnd.randint(6, 10)) for _ in range(rnd.randint(51, 60)))
        for i in (3 * k, 3 * k + 1):
            size[i] = len(passage)
            rows.append((i, f"{word(300)} {passage} {word(200)}"))
        rows.append((3 * k + 2, " ".join(word(7) for _ in range(120))))
    assert {size[i] >= 400 for i in size} == {True, False}
    want = without_repeats([t.encode() for _, t in rows], 400)
    got = {r[0]: tuple(r[1:]) for r in suffixes.remove_repeated_bytes(docs_frame(spark, rows), scratch).collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}
    assert all((got[i][1] >= 400) == (size.get(i, 0) + 2 >= 400) for i, _ in rows)         # with the spaces around it


def test_suffix_merge_hard_rows(spark, scratch):
    rows = HARD + [(20, LONG[5000:5399]), (21, LONG[9000:9400]), (22, "z" + LONG[9001:9401]), (23, LONG[3:] + "end")]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffixes.remove_repeated_bytes(docs_frame(spark, rows), scratch, keep_bytes=True).collect()}
    assert got[(20, 399)] == (0, 0) and got[(21, 400)] == (400, 1)
    assert got[(22, 401)] == (400, 1)
    assert got[(7, len(LONG))] == (len(LONG), 1) == got[(8, len(LONG))] and got[(23, len(LONG))] == (len(LONG) - 3, 1)
    assert got[(10, 5000)] == (5000, 1) and got[(1, 0)] == (0, 0)
    assert suffixes.remove_repeated_bytes(docs_frame(spark, []), scratch).count() == 0


def test_long_texts_in_slices_keep_every_window(monkeypatch):
    shape = suffixes.Shape(60)
    texts = [t.encode() for t in pasted(random.Random(8), 40)] + [LONG.encode()[:20000]]

    def windows():
        out = {}
        for data, starts, text, offset in suffixes.pieces(texts, shape):
            piece, anchor, first, last, prefix, _ = suffixes.anchors(data, starts, shape)
            base = offset[piece] - starts[piece]
            for t, a, x, y, h in zip(text[piece], anchor + base, first + base, last + base, prefix):
                out.update({(t, p): (p - a, h) for p in range(x, y + 1)})
        return out

    whole = windows()
    monkeypatch.setattr(suffixes, "SLICE", 500)
    assert windows() == whole
    assert set(whole) == {(t, p) for t, x in enumerate(texts) for p in range(len(x) - 59)}
    by_bytes = {}
    assert all(by_bytes.setdefault(texts[t][p:p + 60], found) == found for (t, p), found in whole.items())


def test_interleave_of_shards_is_the_sorted_order():
    rnd = random.Random(9)
    shape = suffixes.Shape(64)
    rows = [[(rnd.randrange(4), 0, 0, 1, 0, 0, 0, bytes(rnd.choice(b"ab") for _ in range(rnd.choice([3, 9, 40]))) + b"x" * rnd.randint(0, 40)) for _ in range(25)] for _ in range(6)]
    runs = [suffixes.sorted_run(r, shape) for r in rows]
    merged = sorted((p, s, k, b, c) for s, r in enumerate(runs) for p, k, b, c in zip(r["prefix"], r["place"].tolist(), r["bytes"], r["common"].tolist()))
    prefix, shard, own = (np.array([m[i] for m in merged]) for i in (0, 1, 4))
    words = suffixes.symbols([m[3] for m in merged], shape.right)
    order, common = suffixes.interleave(prefix, shard, words, own)
    padded = [m[3].ljust(64, b"\0") for m in merged]
    keys = [(prefix[i], padded[i]) for i in order]
    assert keys == sorted(keys)
    for k in range(len(order)):
        if k == 0 or keys[k][0] != keys[k - 1][0]:
            assert common[k] == -1
        else:
            x, y = keys[k - 1][1], keys[k][1]
            assert common[k] == next((i for i in range(64) if x[i] != y[i]), 64)
