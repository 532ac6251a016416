"""Near-duplicate vectors by a forest of random-projection trees.

Trees are fitted on a bounded sample (``Forest.sample`` vectors of the smallest hashes): a node splits its sample along a
random projection, where the fewest vectors lie near the split for what it gains, down to nodes that stand for about
``leaf`` vectors of the whole table. A node of which ``DENSE`` of the pairs link is a family of near copies: a split would
part its links at every level, so it stays one leaf. Every vector of the table is then sent down every tree; where it lies
within ``spill`` deviations of a split it goes down both sides. Inside a leaf all cosines are computed in double precision,
in tiles, and links of at least ``cosine`` are kept: nothing below it can link. A pair that meets in several leaves counts
in the first of them only, which both rows can tell from the leaf lists that they carry; so tasks send on counts and a
spanning set of links, not pairs, and groups of copies stay linear. A leaf with more than ``TILE`` vectors is cut into
tiles, and every two tiles meet in a task of their own, but for tiles of one earlier family, whose pairs have met there.

How many trees there are follows the table: ``QUERIES`` vectors are multiplied with all of it, and trees are added until
``recall`` of their links share a leaf; if ``most`` trees don't reach it, leaves are made four times as large, at last to
one leaf that holds all.

Components come from the distributed union of the links. Null or zero vectors, or ones holding null or non-finite values,
link with nothing, and vectors of different widths don't link. A width of at most ``TILE`` vectors is one leaf. Repeated ids are one
number: links between its rows don't count, its links to others add up over its rows, and each row gets the number's result.
Labels aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import arrowio
from sessionloom.llm.components import UnionFind, components

TILE = 2048
#: Share of linking pairs from which a node isn't split. Vectors whose links recall is measured on; pairs judged a batch.
DENSE, QUERIES, JUDGED = 0.25, 512, 2000


@dataclass(frozen=True)
class Forest:
    trees: int = 8
    most: int = 32
    recall: float = 0.999
    leaf: int = 512
    spill: float = 0.16
    sample: int = 20_000
    seed: int = 1


def _clean(values, width: int | None = None) -> np.ndarray | None:
    """The unit vector in double precision, or None for one that links with nothing."""
    if values is None or None in values or (width is not None and len(values) != width):
        return None
    x = np.asarray(values, np.float64)
    if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _split(projected: np.ndarray, near: float) -> float:
    """The threshold with the fewest values within ``near`` of it for the bits that it tells."""
    ordered = np.sort(projected)
    at = np.unique(np.linspace(0.1, 0.9, 33) * (len(ordered) - 1)).astype(int)
    at = at[ordered[at] < ordered[-1]]
    if not len(at):
        return float(ordered[-1])
    middle = (ordered[at] + ordered[at + 1]) / 2
    low = np.searchsorted(ordered, middle, side="right") / len(ordered)
    low = np.clip(low, 1e-9, 1 - 1e-9)
    bits = -low * np.log2(low) - (1 - low) * np.log2(1 - low)
    cut = np.searchsorted(ordered, middle + near, side="right") - np.searchsorted(ordered, middle - near)
    return float(middle[((cut + 1) / bits).argmin()])


def fit(vectors: np.ndarray, rows: int, forest: Forest, cosine: float = 0.9) -> list[dict]:
    """Trees as arrays: direction, threshold, margin and children of each node; children under zero are leaves.

    ``dense``: the leaves that are whole families.
    """
    trees, width = [], vectors.shape[1]
    stand_for = max(1.0, rows / max(1, len(vectors)))
    for t in range(forest.trees):
        rng = np.random.Generator(np.random.PCG64(forest.seed * 1000 + t))
        nodes: list[list] = []
        dense: set[int] = set()
        leaves = 0

        def grow(members: np.ndarray, depth: int) -> int:
            nonlocal leaves
            if len(members) * stand_for <= forest.leaf or len(members) < 4 or depth > 60:
                leaves += 1
                return -leaves
            some = vectors[rng.choice(members, min(len(members), 256), replace=False)]
            linked = ((some @ some.T >= cosine).sum() - len(some)) / (len(some) * (len(some) - 1))
            direction = rng.standard_normal(width)
            projected = vectors[members] @ direction
            # a direction's length is about the root of the width, so this is what a link's ends differ by
            middle, deviation = _split(projected, float(np.sqrt(2 - 2 * min(cosine, 1.0)))), float(projected.std())
            low = projected <= middle
            if linked >= DENSE or low.all() or not low.any() or deviation == 0:
                leaves += 1
                dense.add(leaves)
                return -leaves
            at = len(nodes)
            nodes.append([direction, middle, forest.spill * deviation, 0, 0])
            nodes[at][3], nodes[at][4] = grow(members[low], depth + 1), grow(members[~low], depth + 1)
            return at

        root = grow(np.arange(len(vectors)), 0)
        columns = list(zip(*nodes, strict=True)) if nodes else [[np.zeros(width)], [0.0], [0.0], [-1], [-1]]
        trees.append({"root": root, "direction": np.array(columns[0]), "middle": np.array(columns[1]), "margin": np.array(columns[2]), "child": np.array([columns[3], columns[4]]), "dense": dense})
    return trees


def leaves_of(x: np.ndarray, trees: list[dict]) -> list[list[int]]:
    """For each row the leaves it lies in, as tree << 32 | leaf, ascending."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    for t, tree in enumerate(trees):
        at, rows = np.full(len(x), tree["root"]), np.arange(len(x))
        projected = x @ tree["direction"].T
        while len(rows):
            done = at < 0
            for row, leaf in zip(rows[done].tolist(), (-at[done]).tolist(), strict=True):
                out[row].append(t << 32 | leaf)
            at, rows = at[~done], rows[~done]
            off = projected[rows, at] - tree["middle"][at]
            left, right = off <= tree["margin"][at], off > -tree["margin"][at]
            at, rows = np.concatenate((tree["child"][0][at[left]], tree["child"][1][at[right]])), np.concatenate((rows[left], rows[right]))
    return [sorted(x) for x in out]


def met_before(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """For rows ``a`` by rows ``b``, whether they share a leaf before ``leaf``."""
    mine, other = ([lists[k][lists[k] < leaf] for k in side] for side in (a, b))
    shared = np.intersect1d(np.concatenate(mine), np.concatenate(other))
    if not len(shared):
        return np.zeros((len(a), len(b)), bool)
    marks = []
    for side in (mine, other):
        row, value = np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side)
        at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
        hit = shared[at] == value
        marks.append(np.zeros((len(side), len(shared)), np.float32))
        marks[-1][row[hit], at[hit]] = 1
    return marks[0] @ marks[1].T > 0


def tile_links(ids: np.ndarray, x: np.ndarray, lists: list[np.ndarray], tile: np.ndarray, leaf: int, first: int, second: int, cosine: float) -> tuple[Counter, list[tuple[int, int]]]:
    """Links of a leaf between rows of tiles ``first`` and ``second`` that no earlier leaf has: counts by id, spanning links."""
    a, b = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
    n_links, group = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for k in range(0, len(a), 512):
        rows = a[k : k + 512]
        hit = x[rows] @ x[b].T >= cosine
        if first == second:
            hit &= rows[:, None] < b[None, :]
        hit &= ids[rows][:, None] != ids[b][None, :]
        i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(i):
            continue
        hit = hit[np.ix_(i, j)] & ~met_before(lists, rows[i], b[j], leaf)
        n_links[rows[i]] += hit.sum(1)
        n_links[b[j]] += hit.sum(0)
        for row, others in zip(rows[i].tolist(), hit, strict=True):
            found = group[b[j[others]]]
            if (found != group[row]).any():
                joined = np.unique(np.append(found, group[row]))
                group[np.isin(group, joined)] = joined[0]
    counts: Counter = Counter()
    for row in np.flatnonzero(n_links).tolist():
        counts[int(ids[row])] += int(n_links[row])
    return counts, [(int(ids[g]), int(ids[row])) for row, g in enumerate(group.tolist()) if ids[g] != ids[row]]


def pick(usable: DataFrame, sample: list[tuple[int, np.ndarray]], rows: int, width: int, forest: Forest, cosine: float) -> list[dict]:
    """The fewest trees, ``forest.trees`` at least, that hold ``forest.recall`` of the links of some vectors with the table."""
    vectors = np.array([y for _, y in sample])
    asked, q = np.array([i for i, _ in sample[:QUERIES]]), vectors[:QUERIES]
    context = usable.sparkSession.sparkContext
    while True:
        for number in dict.fromkeys((forest.trees, max(forest.trees, forest.most))):
            trees = fit(vectors, rows, replace(forest, trees=number), cosine)
            if all(t["root"] < 0 for t in trees):
                return trees[:1]
            held = context.broadcast((trees, q, asked, [set(x) for x in leaves_of(q, trees)]))

            @arrowio.lean
            def judge(batches):
                trees, q, asked, known = held.value
                rng = np.random.Generator(np.random.PCG64(1))
                found = np.zeros(len(trees) + 1)
                for batch in batches:
                    for k in range(0, batch.num_rows, 512):
                        part = batch.slice(k, 512)
                        rows = [(i, y) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if (y := _clean(v, width)) is not None]
                        if not rows:
                            continue
                        x = np.array([y for _, y in rows])
                        i, j = np.nonzero((x @ q.T >= cosine) & (np.array([r[0] for r in rows])[:, None] != asked[None, :]))
                        if not len(i):
                            continue
                        weight = max(1.0, len(i) / JUDGED)
                        if weight > 1:
                            some = rng.choice(len(i), JUDGED, replace=False)
                            i, j = i[some], j[some]
                        own, back = np.unique(i, return_inverse=True)
                        lists = leaves_of(x[own], trees)
                        for n, m in zip(back.tolist(), j.tolist(), strict=True):
                            at = min((y for y in lists[n] if y in known[m]), default=len(trees) << 32)
                            found[at >> 32] += weight
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found)], names=["tree", "n"])

            sums = {r.tree: r.n for r in usable.mapInArrow(judge, "tree int, n double").groupBy("tree").agg(F.sum("n").alias("n")).collect()}
            total, had = sum(sums.values()), np.cumsum([sums.get(t, 0.0) for t in range(number)])
            enough = np.flatnonzero(had >= forest.recall * total - 1e-9)
            if len(enough):
                return trees[: max(forest.trees, int(enough[0]) + 1)]
        forest = replace(forest, leaf=4 * forest.leaf)


def tiles_of(sizes: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """leaf -> (family, first tile, tiles) of leaves beyond one tile, from (leaf, earlier family or -1, rows)."""
    by_leaf: dict[int, Counter] = defaultdict(Counter)
    for leaf, family, n in sizes:
        by_leaf[leaf][family] += n
    out = {}
    for leaf, groups in by_leaf.items():
        if sum(groups.values()) > TILE:
            few = [g for g, n in groups.items() if g < 0 or n < TILE // 4]
            parts = [(-1, sum(groups[g] for g in few))] * bool(few) + sorted((g, n) for g, n in groups.items() if g not in few)
            out[leaf], at = [], 0
            for family, n in parts:
                out[leaf].append((family, at, -(-n // TILE)))
                at += -(-n // TILE)
    return out


def links_of(found: DataFrame, width: int | None, cosine: float) -> DataFrame:
    """(vec_id, n, other) from dealt rows: counts of links by id, other being null, and links that span them.

    width: of vectors that may come in single precision; without one all come as double-precision unit vectors.
    """

    def unit(value: bytes) -> np.ndarray:
        return _clean(np.frombuffer(value, np.float32).tolist()) if width and len(value) == 4 * width else np.frombuffer(value)

    @arrowio.lean
    def link(batches):
        key, held = None, []
        counts: Counter = Counter()
        ties: list[tuple[int, int]] = []

        def done():
            if len(held) > 1:
                ids = np.array([h[1] for h in held])
                x = np.array([unit(h[3]) for h in held])
                lists = [np.frombuffer(h[2], np.uint32) for h in held]
                leaf, first, second = key
                more, tied = tile_links(ids, x, lists, np.array([h[0] for h in held]), leaf >> 32 << 20 | leaf & 0xFFFFF, first, second, cosine)
                counts.update(more)
                ties.extend(tied)

        def out():
            rows = [(i, n, None) for i, n in counts.items()] + [(a, 0, b) for a, b in ties]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            counts.clear()
            ties.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["vec_id", "n", "other"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for leaf, first, second, *rest in zip(*columns, strict=True):
                if (leaf, first, second) != key:
                    if key:
                        done()
                    key, held = (leaf, first, second), []
                    if len(counts) + len(ties) > 100_000:
                        yield out()
                held.append(rest)
        if key:
            done()
        yield out()

    dealt = found.repartition("leaf", "first", "second").sortWithinPartitions("leaf", "first", "second")
    return dealt.mapInArrow(link, "vec_id long, n long, other long")


DEALT = "leaf long, first int, second int, tile int, vec_id long, leaves binary, v binary"


def one_leaf(usable: DataFrame) -> DataFrame:
    """Rows dealt to one leaf a width, for widths of few vectors."""

    @arrowio.lean
    def deal(batches):
        for batch in batches:
            rows = [(len(y), 0, 0, 0, i, np.array([len(y) & 0xFFFFF], np.uint32).tobytes(), y.tobytes()) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (y := _clean(v)) is not None]
            if rows:
                yield _dealt(rows)

    return usable.mapInArrow(deal, DEALT)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in DEALT.split(", ")])


def in_forest(usable: DataFrame, width: int, number: int, cosine: float, forest: Forest) -> DataFrame:
    """``links_of`` vectors of one width, met in the leaves of a forest."""
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(forest.sample).collect()
    clean = [(r.vec_id, y) for r in sample if (y := _clean(r.v, width)) is not None]
    context = usable.sparkSession.sparkContext
    trees = context.broadcast(pick(usable, clean, number, width, forest, cosine))


    @arrowio.lean
    def routed(batches):
        """(id, values, unit vector, leaves, families among them) of runs of rows."""
        families = {t << 32 | leaf for t, tree in enumerate(trees.value) for leaf in tree["dense"]}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [(i, v, y) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if (y := _clean(v, width)) is not None]
                if rows:
                    lists = leaves_of(np.array([y for _, _, y in rows]), trees.value)
                    yield [(*r, held, next((x for x in held if x in families), -1)) for r, held in zip(rows, lists, strict=True)]

    @arrowio.lean
    def count(batches):
        n: Counter = Counter()
        for rows in routed(batches):
            n.update((leaf, family if 0 <= family < leaf else -1) for *_, held, family in rows for leaf in held)
        columns = [list(c) for c in zip(*((*k, v) for k, v in n.items()), strict=True)] or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["leaf", "family", "n"])

    # at most as many leaves as the sample has rows, a tree; most are one tile
    sizes = usable.mapInArrow(count, "leaf long, family long, n long").groupBy("leaf", "family").agg(F.sum("n").alias("n")).collect()
    crowded = context.broadcast(tiles_of([tuple(r) for r in sizes]))

    @arrowio.lean
    def deal(batches):
        """A crowded leaf's rows go to each pair of its tiles whose rows haven't met as one earlier family's."""
        for rows in routed(batches):
            out = []
            for i, v, y, held, family in rows:
                small = np.array(v, np.float32)
                value = (small if (small == np.array(v)).all() else y).tobytes()
                blob = np.array([x >> 32 << 20 | x & 0xFFFFF for x in held], np.uint32).tobytes()
                for leaf in held:
                    groups = crowded.value.get(leaf)
                    if groups is None:
                        out.append((leaf, 0, 0, 0, i, blob, value))
                        continue
                    mine = next((g for g in groups if g[0] == family and 0 <= family < leaf), groups[0])
                    tile = mine[1] + zlib.crc32(b"%d %d" % (i, leaf)) % mine[2]
                    for other in groups:
                        if other != mine or mine[0] < 0:
                            out += [(leaf, min(k, tile), max(k, tile), tile, i, blob, value) for k in range(other[1], other[1] + other[2])]
            for k in range(0, len(out), 20_000):
                yield _dealt(out[k : k + 20_000])

    return links_of(usable.mapInArrow(deal, DEALT), width, cosine)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, forest: Forest = Forest(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    # what can link: finite and not all zero
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = read.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    # each width has a forest of its own; those of a tile's vectors at most share a task by width
    widths = {r.width: r.n for r in usable.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    large = sorted(w for w, n in widths.items() if n > TILE)
    parts = [in_forest(usable.where(F.size("v") == w), w, widths[w], cosine, forest) for w in large]
    if len(large) < len(widths) or not parts:
        parts.append(links_of(one_leaf(usable.where(~F.size("v").isin(large))), None, cosine))
    found = arrowio.stage(functools.reduce(DataFrame.union, parts))
    counts = found.where("other is null").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    joined = components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    both = read.select("vec_id").join(counts, "vec_id", "left").join(joined.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return both.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op10_rp_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
