"""Exact n-gram Jaccard self-join: near copies by blocked sparse products of the document by n-gram incidence matrix.

A document is its set of word n-grams. Two documents link when 100 * |A & B| >= percent * |A | B|; the result is each
document's set size and the smallest document it reaches by links.

1. *Classes.* Documents of one set are one node (64-bit set hash, checked by a second one; a clash repeats with other
   numbers). From here on a group of exact copies counts once, however large it is.
2. *Blocks.* Single columns are shared by chance ever more often as the corpus grows, so they are taken together: sets of one
   class of sizes are cut by hash ranges into more parts than two linking sets differ in n-grams, so these have a part in
   common whole, and such whole parts are the merged columns that are dealt into blocks. A set with more empty parts than
   there are parts to spare also deals single columns: those are ordered by frequency, rare ones first, and sets that link
   share one among the first |A| - ceil(percent * |A| / 100) + 1 of each side. A map task ties its own rows of a column
   together and sends one of them on, so a column held by a third of all documents costs a reducer one entry a map task.
3. *Products.* Within a block each row is multiplied with the row of the block's first node: overlap counts, after pairs
   have been discarded whose sizes, or parity outlines of 2048 bits, rule the bound out. The texts of nodes that have a
   tie are shuffled once, into buckets that all products read; a first node with very many rows is split into several
   products.
4. *The rest of a column.* Links join nodes to components. Where a column still spans several components, all its pairs
   between different components that the sizes allow are multiplied, too: pair by pair, or for
   crowded columns tile by tile inside a task, where outlines meet first. Pairs inside a component cannot change it and are left out: this keeps
   a group of thousands of near copies linear without losing a link between components.

Null text or text without words: an empty set, linked with nothing, its own component. Fewer words than n: the whole
sequence is the one n-gram. Repeated rows share a class. Rows of null doc_id link as any other, but a component's id is its
smallest doc_id that isn't null (null where it has none). An empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import arrowio
from sessionloom.llm.components import UnionFind, components
from sessionloom.llm.textwords import U64, Words, grams, mix, numbers

N, PERCENT = 4, 85
#: Entries of a block of columns, and rows of one product, that a task holds at once.
BLOCK, ROWS = 1_000_000, 256
#: Sizes of one class: the largest is about STEP[0] / STEP[1] times the smallest.
STEP, LARGEST = (5, 4), 1 << 36
#: Bits of a row's outline, by which pairs are ruled out.
OUTLINE = 2048
#: Hash ranges whose frequencies order the columns.
SLOT_BITS = 22
#: A column with more open rows than this is multiplied in tiles of TILE rows instead of pair by pair.
CROWD, TILE = 32, 1024
#: Bytes of text that a map task gathers before it ties its rows together.
GATHER = 4 << 20
#: n-grams of all distinct sets for each bucket of texts.
BUCKET = 8_000_000


def ngram_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = Words(texts, lower=True)
    h, first = words.hashes(), words.first.tolist()
    g = grams(h, n)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a, 100 + b - a))
        else:
            out.append(h[:0])
    return out


def _set_hash(s: np.ndarray, seed: int) -> int:
    return int(mix(np.add.reduce(mix(s + numbers(1, seed)[0]), keepdims=True, dtype=U64) + U64(len(s)))[0].astype(np.int64)) if len(s) else 0


def _slots(g: np.ndarray) -> np.ndarray:
    return (g >> U64(64 - SLOT_BITS)).astype(np.int64)


def column_weights(docs: DataFrame, n: int) -> np.ndarray:
    """How frequent the n-grams of each of 2^SLOT_BITS hash ranges are in all texts, on a log scale of one byte.

    Any fixed order of the columns gives right results; this one puts common passages last. The table's size is fixed.
    """
    parts = 64

    @arrowio.lean
    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for _, texts in arrowio.chunks(batches):
            np.add.at(total, _slots(grams(Words(texts, lower=True).hashes(), n)), 1)
        if total.any():
            squeeze = zstandard.ZstdCompressor(level=1).compress
            total = np.minimum(total, 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([squeeze(x.tobytes()) for x in np.split(total, parts)], pa.binary())], names=["part", "counts"])

    @arrowio.lean
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = np.frombuffer(zstandard.decompress(blob.as_py()), np.uint16)
                sums[part] = sums.get(part, 0) + held.astype(np.float64)
        # one byte a slot from here on
        level = [np.minimum(np.log2(1 + x) * 5, 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(level, pa.binary())], names=["part", "levels"])

    levels = docs.mapInArrow(count, "part int, counts binary").repartition(parts, "part").mapInArrow(add, "part int, levels binary").collect()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in levels:
        out[r.part * len(out) // parts :][: len(out) // parts] = np.frombuffer(r.levels, np.uint8)
    return out


def prefix(s: np.ndarray, weights: np.ndarray, percent: int) -> np.ndarray:
    """The set's first columns in the order of weights: sets that link share one of them."""
    n = len(s)
    if 100 * n < percent * (n + 1):
        return s[:0]
    length = n + (-percent * n // 100) + 1
    key = weights[_slots(s)].astype(U64) << U64(56) | s >> U64(8)
    return key if length >= n else np.partition(key, length)[:length]


def size_classes(percent: int) -> np.ndarray:
    """(first size, parts, parts to spare) of each class of sizes.

    Sets that link differ in (100 - percent) / percent of the smaller one's n-grams at most. Its class has a part for each of
    these, one more, and some to spare, as many as are seldom empty.
    """
    rows, first = [], 1
    while first < LARGEST:
        after = max(first + 1, first * STEP[0] // STEP[1])
        differ = (after - 1) * (100 - percent) // percent
        spare = 0
        for _ in range(3):
            empty = (differ + 1 + spare) * math.exp(-first / (differ + 1 + spare))
            spare = int(empty + 2.5 * math.sqrt(empty))
        rows.append((first, differ + 1 + spare, spare))
        first = after
    return np.array(rows)


def merged_columns(s: np.ndarray, classes: np.ndarray, weights: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which sets that link, but aren't equal, share one: the set's whole parts in each class that the smaller of
    it and another set may be of, and its prefix where too many parts are empty.

    If all parts that two linking sets have in common are empty, both have more empty parts than there are to spare.
    """
    n = len(s)
    low, high = np.searchsorted(classes[:, 0], (-(-percent * n // 100), n), side="right") - 1
    mixed, top, out, scant = None, s >> U64(32), [], False
    for c in range(max(int(low), 0), int(high) + 1):
        parts, spare = classes[c, 1:].tolist()
        # one part and none to spare: they would have to be equal
        if parts - spare <= 1:
            continue
        if mixed is None:
            mixed = mix(s)
        part = (top * U64(parts)) >> U64(32)
        start = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        out.append(mix(np.add.reduceat(mixed, start) + mix(part[start] + U64(c << 40))))
        scant |= parts - len(start) > spare
    if scant:
        out.append(prefix(s, weights, percent))
    return np.concatenate(out) if out else s[:0]


def outline_of(s: np.ndarray) -> bytes:
    """OUTLINE bits, each the parity of the set's n-grams that fall on it: sets that differ in d n-grams differ in d bits at most."""
    bits = np.bincount((s >> U64(20)).astype(np.int64) % OUTLINE, minlength=OUTLINE).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()


def sets_of(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """doc_id, key, n_shingles, node, second, outline: set sizes, hashes and outlines; the last three are null for an empty set."""

    def kernel(ids, texts):
        found = ngram_sets(texts, n)
        hashes = [[_set_hash(s, seed + k) if len(s) else None for s in found] for k in (0, 1)]
        kept = [outline_of(s) if len(s) else None for s in found]
        columns = ([i["doc_id"] for i in ids], [i["key"] for i in ids], list(map(len, found)), *hashes)
        return *(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.binary())

    both = docs.select(F.struct("doc_id", "key").alias("id"), "text")
    return arrowio.map_chunks(both, kernel, "doc_id long, key long, n_shingles long, node long, second long, outline binary")


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order without repetitions: keys, nodes, where a key starts, and each entry's first node of its key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    if len(keys):
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
        keys, nodes = keys[new], nodes[new]
    start = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    return keys, nodes, start, nodes[np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))] if len(keys) else nodes


def block_ties(docs: DataFrame, n: int, percent: int, seed: int, blocks: int, weights) -> DataFrame:
    """(part, a, b, more): nodes that share a merged column, each tied to the column's smallest node in its map task or block.

    more: whether the column may have other ties, so that nodes tied to one node still have to meet. A key's lowest bit says
    that its map task has tied rows of the column.
    """
    classes = size_classes(percent)

    def deal(ids, texts):
        keys, nodes = [], []
        for s in ngram_sets(texts, n):
            if len(s):
                keys.append(merged_columns(s, classes, weights.value, percent))
                nodes.append(np.full(len(keys[-1]), _set_hash(s, seed), np.int64))
        if not keys:
            return None
        keys, nodes, start, first = _stars(np.concatenate(keys) & ~U64(1), np.concatenate(nodes))
        tied = ~start
        rows = [(blocks, np.concatenate((keys[tied].view(np.int64), first[tied], nodes[tied])).tobytes())] if tied.any() else []
        keys |= np.append(tied[1:], False).astype(U64)
        keys, nodes = keys[start], nodes[start]
        block = (mix(keys >> U64(1)) >> U64(40)) * U64(blocks) >> U64(24)
        order = np.argsort(block, kind="stable")
        keys, nodes, block = keys[order], nodes[order], block[order]
        at = np.searchsorted(block, np.arange(blocks + 1, dtype=U64))
        rows += [(k, np.concatenate((keys[a:b].view(np.int64), nodes[a:b])).tobytes()) for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if b > a]
        return pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())

    def batch_of(keys, a, b, more):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (keys, a, b)), pa.array(more, pa.bool_())], names=["part", "a", "b", "more"])

    def tie(parts):
        both = [np.frombuffer(p, np.int64).reshape(2, -1) for p in parts]
        keys, nodes = np.concatenate([x[0] for x in both]).view(U64), np.concatenate([x[1] for x in both])
        marked = np.unique(keys[(keys & U64(1)) == 1] & ~U64(1))
        keys, nodes, start, first = _stars(keys & ~U64(1), nodes)
        tied = ~start
        rank = np.arange(len(keys)) - np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0)) if len(keys) else nodes
        last = np.append(start[1:], True)
        local = np.isin(keys, marked)
        many = np.isin(keys, keys[(rank > 1) & last]) | local
        # columns with the same rows, as a shared passage has many, are one: their hash of rows stands for them
        at = np.flatnonzero(start)
        if len(at):
            rows = np.repeat(mix(np.add.reduceat(mix(nodes.view(U64)), at)), np.diff(np.append(at, len(keys))))
            keys = np.where(local, keys, np.where(many, rows, U64(0)))
        return batch_of(keys[tied].view(np.int64), first[tied], nodes[tied], many[tied])

    @arrowio.lean
    def run(batches):
        block, held = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k == blocks:
                    mine = np.frombuffer(blob.as_py(), np.int64).reshape(3, -1)
                    yield batch_of(*mine, np.ones(mine.shape[1], bool))
                    continue
                if k != block:
                    if held:
                        yield tie(held)
                    block, held = k, []
                held.append(blob.as_py())
        if held:
            yield tie(held)

    dealt = arrowio.map_chunks(docs, deal, "block int, entries binary", GATHER)
    # what map tasks have tied themselves goes on as it is, dealt evenly
    spread = F.when(F.col("block") == blocks, F.xxhash64("entries")).otherwise(0)
    return dealt.repartition(max(1, blocks), "block", spread).sortWithinPartitions("block").mapInArrow(run, "part long, a long, b long, more boolean")


def possible(pairs: DataFrame, outline: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that sizes and outlines don't rule out."""
    one = outline.select(F.col("node").alias("a"), F.col("size").alias("a_n"), F.col("outline").alias("a_x"))
    two = outline.select(F.col("node").alias("b"), F.col("size").alias("b_n"), F.col("outline").alias("b_x"))
    near = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent

    @arrowio.lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (3, 5))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
                keep = pa.array(apart * (100 + percent) <= total * (100 - percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").where(near).select("a", "b", "a_n", "a_x", "b_n", "b_x").mapInArrow(run, "a long, b long")


def with_texts(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """rows, that have a node, with its text: found by the node's key, in whose buckets the texts lie."""
    keys = nodes.select(F.col("node").alias("__node"), "key")
    return rows.join(keys, F.col("node") == F.col("__node")).join(texts, "key").select(*rows.columns, "text")


def products(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """(a, b) pairs that link; texts of another set than the node's are passed over."""
    rest = F.pmod(F.xxhash64("b"), F.col("splits"))
    split = pairs.groupBy("a").agg(F.ceil(F.count("*") / ROWS).alias("splits"))
    dealt = pairs.join(split, "a").select("a", rest.alias("s"), F.col("b").alias("node"))
    firsts = split.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("s"), F.col("a").alias("node"))
    wanted = with_texts(dealt.union(firsts), nodes, texts)

    def product(group):
        sets = ngram_sets([t for _, t in group], n)
        true = [_set_hash(s, seed) == node for s, (node, _) in zip(sets, group, strict=True)]
        first = next((k for k, (node, _) in enumerate(group) if node == group.a and true[k]), None)
        if first is None:
            return []
        size, s = len(sets[first]), sets[first]
        kept = [k for k in range(len(sets)) if group[k][0] != group.a and true[k] and 100 * min(size, len(sets[k])) >= percent * max(size, len(sets[k]))]
        if not kept:
            return []
        columns = np.concatenate([sets[k] for k in kept])
        at = np.searchsorted(s, columns)
        hit = s[np.minimum(at, size - 1)] == columns
        sizes = np.array([len(sets[k]) for k in kept])
        overlap = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        return [(group.a, group[k][0]) for k, o, m in zip(kept, overlap.tolist(), sizes.tolist(), strict=True) if 100 * o >= percent * (size + m - o)]

    class Group(list):
        a: int

    @arrowio.lean
    def run(batches):
        key, group, out = None, Group(), []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, s, node, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3).cast(pa.large_binary()), strict=True):
                if (a, s) != key:
                    if key:
                        out += product(group)
                    key, group = (a, s), Group()
                    group.a = a
                    if len(out) >= 10_000:
                        yield batch_of(out)
                        out = []
                group.append((node, text.as_py()))
        if key:
            out += product(group)
        yield batch_of(out)

    return wanted.repartition("a", "s").sortWithinPartitions("a", "s").mapInArrow(run, "a long, b long")


def tile_rows(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of ``dealt`` (family, first, second, tile, node, of, size, outline) that sizes and outlines leave a row of the
    other tile to link with, without size and outline."""
    names = ["family", "first", "second", "tile", "node", "of"]

    def kept(first: int, second: int, rows: list) -> list:
        tiles, of, size = (np.array([r[k] for r in rows]) for k in (0, 2, 3))
        bits = np.frombuffer(b"".join(r[4] for r in rows), U64).reshape(len(rows), -1)
        a, b = np.flatnonzero(tiles == first), np.flatnonzero(tiles == second)
        keep = np.zeros(len(rows), bool)
        for i in a.tolist():
            j = b[(of[b] != of[i]) & (100 * np.minimum(size[b], size[i]) >= percent * np.maximum(size[b], size[i]))]
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            j = j[apart * (100 + percent) <= (size[j] + size[i]) * (100 - percent)]
            if len(j):
                keep[i] = True
                keep[j] = True
        return [rows[k][:3] for k in np.flatnonzero(keep).tolist()]

    @arrowio.lean
    def run(batches):
        key, held = None, []

        def batch_of():
            out = [(*key, *r) for r in kept(*key[1:], held)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for family, first, second, *row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (family, first, second) != key:
                    if key:
                        yield batch_of()
                    key, held = (family, first, second), []
                held.append(row)
        if key:
            yield batch_of()

    schema = "family long, first int, second int, tile int, node long, of long"
    return dealt.repartition("family", "first", "second").sortWithinPartitions("family", "first", "second").mapInArrow(run, schema)


def family_products(members: DataFrame, outline: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """(a, b) links between members (node, family, of) of one family but different ``of``, enough to join what links join.

    A family's rows are cut into tiles; every two tiles meet in a task of their own: first their outlines, then the rows that
    these leave, which are multiplied by blocks of columns.
    """
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, "tile").alias("first"), F.greatest(k, "tile").alias("second")))
    placed = members.join(sizes, "family").join(outline, "node").withColumn("tile", tile).withColumn("meet", F.explode(meets))
    dealt = tile_rows(placed.select("family", "meet.first", "meet.second", "tile", "node", "of", "size", "outline"), percent)

    def product(first: int, second: int, held: list) -> list[tuple[int, int]]:
        sets = ngram_sets([h[3] for h in held], n)
        held, sets = zip(*([(h, s) for h, s in zip(held, sets, strict=True) if _set_hash(s, seed) == h[1]] or [((), ())]), strict=True)
        if len(held) < 2:
            return []
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        columns, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[index] > 1
        owner, index = owner[shared], index[shared]
        order = np.argsort(index, kind="stable")
        owner, index = owner[order], index[order]
        tiles = np.array([h[0] for h in held])
        a, b = np.flatnonzero(tiles == first), np.flatnonzero(tiles == second)
        place_a, place_b = np.full(len(held), -1), np.full(len(held), -1)
        place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
        overlap = np.zeros((len(a), len(b)), np.float32)
        for start in range(0, len(columns), 4096):
            x, y = np.searchsorted(index, (start, start + 4096))
            if x == y:
                continue
            row, column = owner[x:y], index[x:y] - start
            one, two = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
            mine = place_a[row] >= 0
            one[place_a[row[mine]], column[mine]] = 1
            mine = place_b[row] >= 0
            two[place_b[row[mine]], column[mine]] = 1
            overlap += one @ two.T
        of = np.array([h[2] for h in held])
        union = sizes[a][:, None] + sizes[b][None] - overlap
        i, j = np.nonzero((100 * overlap.astype(np.float64) >= percent * union) & (of[a][:, None] != of[b][None]))
        joined = UnionFind()
        # one link between two components is enough
        return [(held[a[p]][1], held[b[q]][1]) for p, q in zip(i.tolist(), j.tolist(), strict=True) if joined.union(int(of[a[p]]), int(of[b[q]]))]

    @arrowio.lean
    def run(batches):
        key, held, out = None, [], []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for family, first, second, *row, text in zip(*columns, batch.column(6).cast(pa.large_binary()), strict=True):
                if (family, first, second) != key:
                    if key:
                        out += product(*key[1:], held)
                    key, held = (family, first, second), []
                held.append((*row, text.as_py()))
        if key:
            out += product(*key[1:], held)
        yield batch_of()

    wanted = with_texts(dealt, nodes, texts)
    return wanted.repartition("family", "first", "second").sortWithinPartitions("family", "first", "second").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    docs = arrowio.id_text(docs, id_col, text_col)
    # where a row's text is found again; rows without an id go by a hash of their text
    docs = docs.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    seed = 1
    while True:
        sized = arrowio.stage(sets_of(docs, n, seed))
        least = (F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("n_shingles").alias("n"))
        classes = sized.where("node is not null").groupBy("node").agg(*least, F.min("second").alias("x"), F.max("second").alias("y"))
        totals = classes.agg(F.sum("n").alias("n"), F.sum((F.col("x") != F.col("y")).cast("long")).alias("clashes")).first()
        if not totals["clashes"]:
            break
        arrowio.drop_stage(sized)
        seed += 2
    nodes = arrowio.stage(classes.select("node", "rep", "key", "n"))
    # about two classes for each set
    blocks = 1 + (totals["n"] or 0) * min(100, 2 * (100 - percent)) // 100 // BLOCK
    weights = spark.sparkContext.broadcast(column_weights(docs, n))
    ties = arrowio.stage(block_ties(docs, n, percent, seed, blocks, weights).distinct())
    tried = arrowio.stage(ties.select("a", "b").distinct())
    involved = tried.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
    outline = arrowio.stage(sized.join(involved, ["node", "key"]).select("node", F.col("n_shingles").alias("size"), "outline").dropDuplicates(["node"]))
    likely = arrowio.stage(possible(tried, outline, percent))
    # the texts of nodes that have a tie, shuffled once
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (totals["n"] or 0) // BUCKET)
    texts = docs.select("key", "text").repartition(buckets, "key").join(involved.select("key").distinct(), "key", "left_semi")
    texts = arrowio.stage_bucketed(texts, "key", buckets)
    links = arrowio.stage(products(likely, nodes, texts, n, percent, seed))
    arrowio.drop_stage(likely)
    joined = arrowio.stage(components(links))
    # columns whose nodes are still in several components, and have more nodes than the pair that was tried
    component = lambda col: (joined.select(F.col("node").alias(col), F.col("component").alias(f"{col}_of")), col)
    seen = ties.where("more").join(*component("a"), "left").join(*component("b"), "left").select("part", "a", "b", F.coalesce("a_of", "a").alias("a_of"), F.coalesce("b_of", "b").alias("b_of"))
    ties_open = seen.where("a_of <> b_of").select("part").distinct()
    both = F.array(*(F.struct(F.col(c).alias("node"), F.col(f"{c}_of").alias("of")) for c in "ab"))
    ends = seen.join(ties_open, "part").select("part", F.explode(both).alias("x")).select("part", "x.node", "x.of").distinct()
    ends = arrowio.stage(ends.join(nodes.select("node", "n"), "node"))
    arrowio.drop_stage(ties)
    crowded = ends.groupBy("part").agg(F.count("*").alias("m"), F.min("node").alias("a")).where(F.col("m") > CROWD).select("part", "a")
    few = ends.join(crowded, "part", "left_anti")
    left = few.select("part", F.col("node").alias("a"), F.col("of").alias("a_of"), F.col("n").alias("a_n"))
    right = few.select("part", F.col("node").alias("b"), F.col("of").alias("b_of"), F.col("n").alias("b_n"))
    near = (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent) & F.expr("a < b and a_of <> b_of")
    open_pairs = left.join(right, "part").where(near).select("a", "b").distinct()
    families = components(ends.join(crowded, "part").select("a", F.col("node").alias("b")))
    members = families.join(ends.select("node", "of").distinct(), "node").select("node", F.col("component").alias("family"), "of")
    untried = open_pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    untried = arrowio.stage(possible(untried, outline, percent))
    more = products(untried, nodes, texts, n, percent, seed).union(family_products(members, outline, nodes, texts, n, percent, seed))
    more = arrowio.stage(more)
    for staged in (tried, outline, ends, untried, texts):
        arrowio.drop_stage(staged)
    if not more.isEmpty():
        joined = arrowio.stage(components(links.union(more)))
    least = joined.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    of_node = joined.join(least, "component").select("node", "least")
    final = nodes.join(of_node, "node", "left").select("node", F.coalesce("least", "rep").alias("least"))
    return sized.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(arrowio.documents(spark, sf_dir))
