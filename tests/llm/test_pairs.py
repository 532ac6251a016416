"""Pair operators against brute force: n-gram join, substring removal, vectors."""

import hashlib
import random
import re

import numpy as np
import pytest

from sessionloom.llm import embedding_dedup, ngram_join, substring_dedup
from sessionloom.llm.components import UnionFind, components


def jaccard_brute(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append(set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    joined = UnionFind()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    joined.union(a, b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least[joined.find(k)] = min(least.get(joined.find(k), i), i)
    return {i: (len(sets[k]), least[joined.find(k)]) for k, (i, _) in enumerate(rows)}


def near_copies(seed, count=300):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.choice([5, 9, 12, 30, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(count):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randint(0, 99))
        if rng.random() < 0.3:
            w += rng.choice(base)[: rng.randint(1, 5)]
        rows.append((i, " ".join(w)))
    rows += [(1500, None), (1501, ""), (1502, "a b"), (1503, "A  b"), (1504, " \n"), (1505, "In " * 300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [32, 2])
def test_ngram_join_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rows = near_copies(3 + crowd)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == jaccard_brute(rows)


def test_ngram_join_ties_no_rows_that_share_columns_by_chance(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdef") for _ in range(120))) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " x") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = spark.sparkContext.broadcast(ngram_join.column_weights(df, 4))
    # any two of the 300 share about eight of their n-grams
    tied = ngram_join.block_ties(df, 4, 85, 1, 1, weights).select("a", "b").distinct().count()
    assert 5 <= tied < len(rows), tied
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == jaccard_brute(rows)


def test_tiles_multiply_only_rows_that_outlines_leave(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(90)) for _ in range(40)]
    texts += [texts[k] + " x" for k in range(3)]
    sets = ngram_join.ngram_sets([t.encode() for t in texts], 4)
    rows = [(7, 0, 0, 0, k, k, len(x), bytearray(ngram_join.outline_of(x))) for k, x in enumerate(sets)]
    dealt = spark.createDataFrame(rows, "family long, first int, second int, tile int, node long, of long, size int, outline binary")
    assert sorted(r.node for r in ngram_join.tile_rows(dealt, 85).collect()) == [0, 1, 2, 40, 41, 42]


@pytest.mark.parametrize("percent", [85, 80, 50, 97])
def test_merged_columns_of_sets_that_link(percent):
    rng = np.random.default_rng(percent)
    classes, weights = ngram_join.size_classes(percent), np.zeros(1 << ngram_join.SLOT_BITS, np.uint8)
    tried = 0
    for n in [*range(1, 41), 55, 90, 160, 400, 1500] * 8:
        # as far apart as the bound allows: some n-grams of one lost, others new
        union = rng.integers(0, 1 << 63, 3 * n + 3, dtype=np.uint64) * np.uint64(2)
        for lost in {0, n * (100 - percent) // 100, int(rng.integers(0, n)), n * (100 - percent) // (100 + percent)}:
            new = (100 * (n - lost) - percent * n) // percent
            if new < 0 or lost + new == 0:
                continue
            one, two = np.sort(union[:n]), np.sort(union[lost : n + new])
            assert 100 * (n - lost) >= percent * (n + new)
            shared = np.intersect1d(*(ngram_join.merged_columns(x, classes, weights, percent) for x in (one, two)))
            assert len(shared), (n, lost, new)
            tried += 1
    assert tried > 100


def test_ngram_join_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node long, part int")
    assert ngram_join.jaccard_components(empty).collect() == []
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, 5, 1), (1, text, 6, 1), (None, "x y", 7, 2), (2, text, 8, 3)]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, node long, part int")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out) == [(-1, 1, -1), (1, 27, 1), (1, 27, 1), (2, 27, 1)]


@pytest.mark.parametrize("middle", [None, 2])
def test_ngram_join_links_through_rows_without_an_id(spark, middle):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base), " ".join([*base[:-5], *"abcde"]), " ".join([*base[:-9], *"wxyzabcde"])]
    rows = [(1, texts[0]), (middle, texts[1]), (3, texts[2]), (None, "p q r s t u"), (None, "")]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == sorted([(1, 97, 1), (middle or 0, 97, 1), (3, 97, 1), (0, 3, 0), (0, 0, 0)])


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    joined = UnionFind()
    for a, b in links:
        joined.union(a, b)
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert out == {x: joined.find(x) for pair in links for x in pair if pair[0] != pair[1] or x in out}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def windows_brute(rows, n=20):
    first, words = {}, {i: (t or "").encode().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (i, k):
                keep[k : k + n] = [False] * n
        kept = [a for a, b in zip(w, keep, strict=True) if b]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("flush", [1 << 23, 2000])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    monkeypatch.setattr(substring_dedup, "BUCKET", 20_000)
    rng = random.Random(flush)
    passages = [[rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.choice([15, 20, 21, 30, 70]))] for _ in range(10)]
    rows = []
    for i in range(250):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages)[rng.choice([0, 0, 0, 3]) :] if rng.random() < 0.6 else [rng.choice("xyz") + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(900, None), (901, ""), (902, "In " * 200), (903, "a b " * 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(df).collect()} == windows_brute(rows)


def test_substring_dedup_edge_cases(spark):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(7, text, "a", 1), (7, text, "b", 2), (None, text, "c", 3), (3, "w1 w2", "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, spans int")
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.key) for r in out.collect()), key=str) == sorted([(7, text, "a"), (7, text, "b"), (None, "", "c"), (3, "w1 w2", "d")], key=str)
    assert substring_dedup.digest(df.limit(0)).collect() == []


def test_substring_dedup_of_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 2000)
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(30)) + f" u{k} {passage} {k}" for k in range(40)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(9, passage + " end")] + [(None, texts[0])] * 3, "doc_id long, text string").repartition(3)
    out = substring_dedup.digest(df).collect()
    assert [(r.n_removed) for r in out if r.doc_id == 9] == [0]
    assert sorted(r.n_removed for r in out if r.doc_id is None) == [30] * 43
    # without the row that has an id, one text keeps the passage, and so do its copies
    kept = [r.n_removed for r in substring_dedup.digest(df.where("doc_id is null")).collect()]
    assert sorted(kept) in ([0] + [30] * 42, [0] * 4 + [30] * 39)


def vectors_brute(rows, cosine=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links, joined = {i: 0 for i, _ in rows}, UnionFind()
    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i] += 1
                links[j] += 1
                joined.union(i, j)
    return {i: (links[i], joined.find(i), joined.find(i) == i) for i, _ in rows}


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k % 40] * (1 + k % 3) + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 1.0])).tolist()) for k in range(500)]
    rows += [(k, base[0].tolist()) for k in range(500, 620)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] + [1.0] * 15), (704, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, forest=embedding_dedup.Forest(leaf=64)).collect()}
    want = vectors_brute(rows)
    assert set(out) == set(want)
    assert all(out[k][0] <= want[k][0] for k in out)
    assert sum(v[0] for v in out.values()) >= 0.9 * sum(v[0] for v in want.values())
    assert np.mean([out[k][1] == want[k][1] for k in out]) >= 0.95


def test_vectors_of_several_widths(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    rng = np.random.default_rng(5)
    rows = []
    for width, count in ((8, 200), (12, 150), (2, 30), (3, 5)):
        base = rng.normal(size=(10, width))
        rows += [(len(rows) + k, (base[k % 10] + rng.normal(size=width) * 0.05).tolist()) for k in range(count)]
    rows += [(5000 + k, None) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, forest=embedding_dedup.Forest(leaf=32)).collect()}
    by_width: dict = {}
    for i, v in rows:
        by_width.setdefault(len(v or ()), []).append((i, v))
    assert out == {k: v for part in by_width.values() for k, v in vectors_brute(part).items()}


def test_vectors_of_the_query_have_nine_tenths_of_all_links(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 32))
    x = base[rng.integers(0, 1500, 6000)] + rng.normal(size=(6000, 32)) * rng.choice([0.05, 0.2, 0.3], (6000, 1))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = np.array([n for _, n in sorted((r.vec_id, r.n_links) for r in embedding_dedup.near_duplicates(df).collect())])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_vectors_edge_cases(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(df).collect() == []
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [1.0, 2.0]), (5, [float("inf"), 1.0])]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in out) == [(-1, 0, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (5, 0, 5)]


def with_family(n, seed=3):
    """Unit vectors of which a third are one family of pairwise cosine about 0.93, and the family's rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[: n // 3] = x[-1] * 0.93**0.5 + x[: n // 3] * 0.07**0.5
    x /= np.linalg.norm(x, axis=1)[:, None]
    order = rng.permutation(n)
    return x[order], np.flatnonzero(order < n // 3)


def test_vectors_of_a_large_family_meet():
    x, family = with_family(105_000)
    trees = embedding_dedup.fit(x[:20_000], len(x), embedding_dedup.Forest())
    lists = [set(found) for found in embedding_dedup.leaves_of(x[family[::5]], trees)]
    links, met = 0, 0
    for k in range(0, len(lists), 50):
        for j in np.flatnonzero(x[family[::5]] @ x[family[5 * k]] >= 0.9).tolist():
            links += 1
            met += bool(lists[k] & lists[j])
    assert met >= 0.999 * links


def test_vectors_of_a_family_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    x, _ = with_family(900)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, forest=embedding_dedup.Forest(leaf=64)).collect()}
    want = vectors_brute(rows)
    assert all(out[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in out.values()) >= 0.999 * sum(v[0] for v in want.values())
