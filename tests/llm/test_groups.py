"""Operators over pairs and groups against brute force: Jaccard join, substring dedup, vectors, chat, components."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.llm import ann, chat, jaccard, kernels, neardup, substring
from hourglass.llm.components import connected_components

from .conftest import DOCS, HARD, docs_frame


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def test_kernels_equal_words_and_windows(monkeypatch):
    monkeypatch.setattr(kernels, "SLICE_BYTES", 200)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \n\té") for _ in range(rnd.randint(0, 60))).encode() for _ in range(300)]
    hashes, first = kernels.hash_texts(texts)
    words = [w for t in texts for w in t.split()]
    names = {}
    assert len(hashes) == len(words) and all(names.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    assert len(set(names.values())) == len(names) and np.diff(first).tolist() == [len(t.split()) for t in texts]
    for width in (1, 2, 5, 50):
        whole, seen = kernels.windows(hashes, width), {}
        starts, _ = kernels.text_windows(first, width)
        assert all(seen.setdefault(tuple(words[s:s + width]), whole[s]) == whole[s] for s in starts.tolist())
        assert len(set(seen.values())) == len(seen)


def test_components(spark, scratch):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(0, i) for i in range(400, 500)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: u.find(x) for a, b in edges if a != b for x in (a, b)}


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def brute_components(rows):
    u, sets = Union(), [(i, shingles(t)) for i, t in rows if i is not None]
    for i, _ in sets:
        u.find(i)
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                u.join(i, j)
    return u


def near_copies(seed, groups=12, copies=14, shared=True):
    """Texts in groups of near copies of varied distance, with passages that many share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(60)], []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([4, 9, 40, 120]))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = word()
            if shared and rnd.random() < 0.4:
                w += passage
            rows.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("long_list", [3, 32])
def test_jaccard_equals_brute_force(spark, scratch, monkeypatch, long_list):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "HOT_FROM", 3)
    rows = near_copies(7) + [(1000 + i, t) for i, t in HARD[:6] if i] + [(None, "x y z")]
    got = jaccard.jaccard_components(docs_frame(spark, rows, extra=True), scratch).collect()
    u = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else u.find(r.doc_id))
    sizes = collections.Counter((i, len(shingles(t))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == sizes


def test_jaccard_keeps_one_per_component(spark, scratch):
    rows = near_copies(8) + [(None, "a b c")]
    u = brute_components(rows)
    kept = jaccard.keep_one_per_component(docs_frame(spark, rows), scratch)
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({u.find(i) for i, _ in rows if i is not None})
    assert kept.filter("doc_id is null").count() == 1
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS), scratch).count() == 0


def test_jaccard_prefix_never_loses_a_link():
    rnd = random.Random(9)
    df = {x: rnd.choice([1, 2, 2, 20, 300]) for x in range(400)}
    for _ in range(3000):
        a = set(rnd.sample(range(400), rnd.randint(1, 60)))
        b = (a - set(rnd.sample(sorted(a), rnd.randint(0, len(a) // 6)))) | set(rnd.sample(range(400), rnd.randint(0, 4)))
        if not b or 100 * len(a & b) < 80 * len(a | b) or a == b:
            continue
        if any(df[x] == 1 for x in a & b):
            continue                                  # a shingle in two sets is no single shingle
        sides = []
        for s in (a, b):
            keys = np.array(sorted(s), np.uint64)
            sides.append((len(s), *jaccard.choose_prefix(keys, np.array([df[int(k)] for k in keys]), 80)))
        (n_a, l_a, p_a), (n_b, l_b, p_b) = sides
        own = lambda n: -(-80 * n // 100)
        needed = min(l_a, l_b) + -(-80 * (n_a + n_b) // 180) - max(own(n_a), own(n_b))
        assert len(set(p_a.tolist()) & set(p_b.tolist())) >= needed


def brute_kept(rows, width):
    starts = collections.defaultdict(list)
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - width + 1):
                starts[tuple(w[k:k + width])].append(i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - width + 1):
                if min(starts[tuple(w[k:k + width])]) < i:
                    gone[k:k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def passages(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abc") for _ in range(3))
    pool, rows = [[word() for _ in range(rnd.choice([49, 50, 55, 90]))] for _ in range(5)], []
    for i in range(70):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(pool) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(1, 40))]
        if rnd.random() < 0.2:
            w += [rnd.choice(["same", "one two", "one two three"])] * rnd.randint(20, 140)
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(w)))
    rows += [(100 + i, " ".join(["x y"] * (30 + i) + ["z"] * i)) for i in range(8)]
    return rows + [(200 + i, rows[3][1]) for i in range(5)]


@pytest.mark.parametrize("group_anchors", [1, 4, 200])
def test_substring_equals_brute_force(spark, scratch, group_anchors):
    rows = passages(11) + [(300 + i, t) for i, t in HARD if i] + [(None, passages(11)[3][1])]
    rows += rows[3:5]
    got = substring.digest_kept(docs_frame(spark, rows, extra=True), scratch, group_anchors=group_anchors).collect()
    want = collections.Counter(x[:4] for x in brute_kept(rows, 50))
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_substring_removal_keeps_columns_and_drops_emptied(spark, scratch):
    rows = passages(12)
    clash = docs_frame(spark, rows, extra=True)
    for c in ("__digest", "__kept", "__id", "__tag", "digest", "kept", "tag"):
        clash = clash.withColumn(c, F.lit("own"))
    got = substring.remove_repeats(clash, scratch)
    want = {i: (kept if gone else dict(rows)[i]) for i, n, gone, _, kept in brute_kept(rows, 50) if not (gone and not kept)}
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert got.columns == clash.columns
    assert all(r.n_chars == len(r.text) and r.kept == r.digest == r["__digest"] == "own" for r in got.collect())
    assert substring.digest_kept(spark.createDataFrame([], DOCS), scratch).count() == 0


def test_suffix_trees_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(100):
        words = [np.array([rnd.randint(0, 2) for _ in range(rnd.randint(5, 40))], np.uint32) for _ in range(rnd.randint(1, 9))]
        doc, group = (np.array([rnd.randint(0, 4) for _ in words]) for _ in range(2))
        flags = substring.shared_suffixes(words, np.array([len(w) - 4 for w in words]), doc, 5, group)
        least = {}
        for w, d, g in zip(words, doc, group):
            for k in range(len(w) - 4):
                key = (g, tuple(w[k:k + 5]))
                least[key] = min(d, least.get(key, d))
        for w, d, g, f in zip(words, doc, group, flags):
            assert f.tolist() == [least[g, tuple(w[k:k + 5])] < d for k in range(len(w) - 4)]
        flat = np.concatenate([np.r_[w, 100 + i] for i, w in enumerate(words)]).astype(np.int64)
        order, levels = substring.suffix_order(flat)
        assert order.tolist() == sorted(range(len(flat)), key=lambda i: flat[i:].tolist())
        for i, j, n in zip(order[:-1], order[1:], substring.common_prefixes(order, levels)):
            assert flat[i:i + n].tolist() == flat[j:j + n].tolist() and (flat[i + n:i + n + 1] != flat[j + n:j + n + 1]).all()


def test_substring_long_unequal_texts_and_a_phrase_one_text_repeats(spark, scratch):
    rnd = random.Random(6)
    long = [f"w{i}" for i in range(30000)]
    other = [*long[:9000], "x", *long[9000:20000], *[f"v{i}" for i in range(9000)]]
    phrase = [f"p{i}" for i in range(60)]
    many = [w for i in range(400) for w in [*phrase, f"n{rnd.random()}"]]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(many)), (4, " ".join(["a", *phrase, "b"]))]
    rows += [(5, " ".join(reversed(long))), (6, " ".join(many[100:]))]
    got = substring.digest_kept(docs_frame(spark, rows), scratch).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {x[:4] for x in brute_kept(rows, 50)}


def vectors(spark, seed, n=400, d=24):
    """Random vectors, a large tight group, pairs around the threshold, copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    center = x[0]
    tight = center + 0.03 * rng.normal(size=(150, d))
    loose = []
    for c in (0.86, 0.89, 0.91, 0.95):
        for a in x[10:25]:
            b = rng.normal(size=d)
            b -= (b @ a) * a
            loose.append(c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b))
    rows = [list(map(float, v)) for v in np.vstack([x, tight, loose, x[30:35], x[30:32], 2 * x[40:42]])]
    rows += [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 0.0], [1.0, 0.1]]
    data = list(enumerate(rows))
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in data] + [(None, rows[0], 1, "x")],
                                  "vec_id long, embedding array<double>, label int, score string")
    return data, frame


def usable(v):
    return v and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_neardup_equals_brute_force(spark, scratch):
    data, frame = vectors(spark, 21)
    got = {r.vec_id: r for r in neardup.near_duplicates(frame, scratch).collect()}
    u, links = Union(), collections.Counter()
    good = [(i, np.array(v)) for i, v in data if usable(v)]
    for i, _ in data:
        u.find(i)
    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    assert len(got) == len(data) + 1 and got[None].component_id is None
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i, _ in data} == {i: (links[i], u.find(i), u.find(i) == i) for i, _ in data}
    assert neardup.near_duplicates(spark.createDataFrame([], frame.schema), scratch).count() == 0


@pytest.mark.parametrize("dimension, rows", [(64, 1500), (768, 400)])
def test_neardup_hash_meets_pairs_at_the_threshold(dimension, rows):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(rows, dimension))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    k, probes, tables = neardup.parameters(50_000, dimension)
    assert tables >= neardup.parameters(50_000, 64)[2]
    met = np.zeros(len(a), bool)
    for t in range(tables):
        x, y = neardup.bucket_ids(a, t, k, probes), neardup.bucket_ids(b, t, k, probes)
        met |= (x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)
    assert met.mean() > 0.995


def brute_nearest(data, k):
    good = [(i, np.array(v)) for i, v in data if usable(v)]
    for i, a in good:
        if i % 20 == 0:
            scored = sorted((-(a * b).sum(), j) for j, b in good if j != i and len(a) == len(b))[:k]
            yield i, [j for _, j in scored], [-s for s, _ in scored]


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_ann_equals_brute_force_and_windows_find_neighbours(spark, scratch, block_rows):
    data, frame = vectors(spark, 22)
    found = ann.nearest(frame, F.col("vec_id") % 20 == 0, scratch, k=20, block_rows=block_rows).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    want = {i: (ids, scores) for i, ids, scores in brute_nearest(data, 20)}
    assert set(got) == {i for i, (ids, _) in want.items() if ids}
    for i, rows in got.items():
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert np.allclose([r.score for r in rows], want[i][1], rtol=0, atol=1e-12)
        assert [r.vec_id for r in rows] == want[i][0]
    quick = ann.nearest(frame, F.col("vec_id") % 20 == 0, scratch, k=20, block_rows=64, complete=False)
    hit = sum(r.vec_id in want[r.query_id][0] for r in quick.collect())
    assert hit > 0.5 * sum(len(ids) for ids, _ in want.values())
    assert ann.nearest(spark.createDataFrame([], frame.schema), F.col("vec_id") % 20 == 0, scratch).count() == 0


@pytest.mark.parametrize("block_rows", [64, 1024])
def test_ann_repeated_rows_and_ids_take_no_ones_place(spark, scratch, block_rows):
    rng = np.random.default_rng(23)
    centers = rng.normal(size=(6, 16))
    data = [(i, list(map(float, centers[i % 6] + 0.05 * rng.normal(size=16)))) for i in range(240)]
    rows = data * 2 + [data[61]] * 48                        # every row twice, one id 50 times
    rows += [(67, list(map(float, 3 * centers[1] + 0.05 * rng.normal(size=16)))) for _ in range(50)]  # one id, 50 vectors, nearest of all
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scores = collections.defaultdict(dict)
    for i, a in rows:
        if i % 20 == 0:
            for j, b in rows:
                if j != i:
                    scores[i][j] = max(scores[i].get(j, -np.inf), float((np.array(a) * np.array(b)).sum()))
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, scratch, k=20, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(scores)
    for i, found in got.items():
        want = sorted(scores[i].items(), key=lambda x: (-x[1], x[0]))[:20]
        assert [(n, j) for n, j, _ in found] == [(n + 1, j) for n, (j, _) in enumerate(want)]
        assert np.allclose([s for *_, s in found], [s for _, s in want], rtol=0, atol=1e-12)


def test_hilbert_curve_visits_every_cell_by_single_steps():
    side, axes = 3, 3
    cells = np.array(np.meshgrid(*[np.arange(1 << side)] * axes, indexing="ij")).reshape(axes, -1).T
    key = ann.hilbert_key(cells, side)
    path = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_chat_round_trip_on_hostile_texts():
    rnd = random.Random(6)
    bits = ["<", "|", "end", "|>", "\\", "\n", "</s>", "[INST]", "[/INST]", "<s>", "x", "<|end|>\n", "<|image:0|>"]
    for _ in range(4000):
        turns = [{"role": "".join(rnd.choice("a|>\\<[\n") for _ in range(rnd.randint(0, 5))),
                  "parts": [{"kind": "text", "text": "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))}]} for _ in range(3)]
        done = chat.format_turns(turns, frozenset(["a"]), chat.TOKENS_PER_UNIT)
        assert chat.parse_turns(done["formatted"]) == [(t["role"], t["parts"][0]["text"]) for t in turns]
        body = done["formatted"]
        assert not any(c in body for c in ("</s>", "[INST]", "[/INST]", "<s>"))


def test_chat_rows_order_loss_and_attachments(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "a"), (1, 2, "assistant", "b</s>"), (2, None, None, None), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_conversations(df)).collect()}
    want = "user\na\nassistant\nb</s>\nassistant\nb</s>\n"
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 10, hashlib.sha256(b"b</s>b</s>").hexdigest())
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0) and got[None].loss_chars == 1
    parts = [{"kind": "text", "text": "see ", "ref": None, "units": None}, {"kind": "image", "text": None, "ref": "i.png", "units": 2.0},
             {"kind": "audio", "text": None, "ref": "a.wav", "units": 1.5}, {"kind": "document", "text": None, "ref": "d.pdf", "units": None},
             {"kind": "odd", "text": None, "ref": "o", "units": -1.0}]
    df = spark.createDataFrame([(1, 1, "user", None, parts), (1, 2, "assistant", "ok", None)],
                               f"conv_id long, turn int, role string, text string, parts {chat.PART_TYPE}")
    row = chat.format_conversations(df, parts="parts").first()
    assert row.formatted == "<|user|>\nsee <|image:0|><|audio:1|><|document:2|><|file:3|><|end|>\n<|assistant|>\nok<|end|>\n"
    assert [(a.kind, a.ref, a.tokens, row.formatted[a.position:a.position + 2]) for a in row.attachments] == [
        ("image", "i.png", 512, "<|"), ("audio", "a.wav", 38, "<|"), ("document", "d.pdf", 512, "<|"), ("file", "o", 0, "<|")]
    assert row.expanded_tokens == 512 + 38 + 512
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
