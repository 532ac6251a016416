"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays that workers memory-map.

Counting. Map tasks count the n-grams of the highest order in runs of text and send them, as word hashes with counts, to
blocks by ranges of their context's hash, so that a block knows all followers of its contexts; n-grams of frequent contexts
(``HOT_SLOTS`` hash ranges are counted first; a range with over half a block's share is hot) go by their own hash instead and
their contexts' sums are merged afterwards, so no word makes a block heavy. A block merges its n-grams and passes down one
continuation for each distinct one: the counts of order k - 1 are numbers of distinct left neighbours. Every block
writes its sorted hashes and values as one flat file in the shared folder; the driver keeps only totals and discounts. The
blocks are worked through in ``PASSES`` rounds, so that the rows on their way to them never lie on disk all at once.

Scoring. A worker maps the files of the blocks (where the shared folder isn't a mounted path, a copy that it unlinks
at once) and looks up the sorted hashes of a run of text by binary search. The probability of a word is
(c - D(c)) / sum(context) + gamma(context) * p(shorter context), where an unseen context passes on the shorter one's, down
to unigrams by continuation counts and 1 / (V + 1) for every word, known or not. D has a value each for counts of 1, 2 and
3 or more, from the numbers of n-grams that occur one to four times.

Texts are lower-cased (A-Z), words are runs outside 0x20 and 0x09-0x0D, an end token follows each text and order - 1 begin
tokens precede it as context. Hashes have 64 bits, of which a file keeps 40 and the leading ones of its index: an n-gram that never
occurred is taken for another one about once in 10^10 times, whatever the number of blocks. Null text counts as empty (its end token is scored and learnt). Repeated rows
count as often as they occur. Without training rows every token gets the uniform floor. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import arrowio
from sessionloom.llm.textwords import U64, Words, grams, mix, numbers

BEGIN, END = numbers(2, 99)
#: Bytes of text a map task counts before it sends; bytes of the training text for each block.
FLUSH, BLOCK = 10 << 20, 16 << 20
#: Bytes of text scored at once: an n-gram that occurs again in a run is looked up once.
RUN = 8 << 20
#: Rounds in which blocks are counted: each reads the text once and has this share of the n-grams on disk.
PASSES = 4
RAW, CONTEXT, HOT = 1000, 100, 200
HOT_SLOTS = 1 << 16
SCHEMA = "kind int, block int, packed binary, stats array<long>"


@dataclass
class Model:
    order: int
    folder: str
    blocks: int
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    #: of the continuation counts of single words: their sum, and how many are 1, 2, 3 or more
    unigrams: tuple[int, int, int, int] = (0, 0, 0, 0)
    vocabulary: int = 0
    tokens: int = 0
    #: which hash ranges of contexts are hot
    hot: bytes = b""


def tokens_of(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with order - 1 begin tokens before and an end token after each text; where each text starts (one more at the end)."""
    words = Words(texts, lower=True)
    h, n = words.hashes(), len(texts)
    at = words.first + np.arange(n + 1) * order
    out = np.full(int(at[-1]), BEGIN, U64)
    out[np.arange(len(h)) + words.owner() * order + order - 1] = h
    out[at[1:] - 1] = END
    return out, at


def sort_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a stable order of hashes, the hashes in it).

    Places stand in the low bits of the hashes while these are sorted, as plain numbers sort several times faster than places
    by number; the few runs that differ in those low bits only are sorted again.
    """
    bits = U64(len(h).bit_length())
    low = (U64(1) << bits) - U64(1)
    key = h & ~low | np.arange(len(h), dtype=U64)
    key.sort()
    order = (key & low).view(np.int64)
    out = h[order]
    back = np.flatnonzero(out[1:] < out[:-1])
    if len(back):
        key &= ~low
        for a, b in dict.fromkeys(zip(np.searchsorted(key, key[back]).tolist(), np.searchsorted(key, key[back], "right").tolist(), strict=True)):
            order[a:b] = order[a:b][np.argsort(out[a:b], kind="stable")]
            out[a:b] = h[order[a:b]]
    return order, out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the sorted distinct numbers, where each stands, which one each number is)."""
    order, ordered = sort_hashes(h)
    new = np.ones(len(h), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(h), np.uint32)
    back[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return ordered[new], order[new], back


def gram_hashes(words: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Hash of each n-gram given as n rows of places in ``words``; equal to that of ``grams`` over running text."""
    out = np.zeros(columns.shape[1], U64)
    for column, factor in zip(columns, numbers(len(columns), 1000) | U64(1), strict=True):
        out += words[column] * factor
    return mix(out)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """By other bits than those that order a block's hashes."""
    return ((mix(h + U64(1)) >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)


def _pack(words: np.ndarray, columns: np.ndarray, values: np.ndarray) -> bytes:
    """N-grams as places in a dictionary of their own words, and values."""
    if columns.size < len(words) >> 3:
        used = np.sort(columns, axis=None)
        used = used[np.append(True, used[1:] != used[:-1])]
    else:
        there = np.zeros(len(words), bool)
        there[columns] = True
        used = np.flatnonzero(there)
    place = np.empty(len(words), np.uint16 if len(used) < 1 << 16 else np.uint32)
    place[used] = np.arange(len(used))
    index = place[columns]
    head = np.array([*columns.shape, len(used), *values.shape], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + words[used].tobytes() + index.tobytes() + values.astype(np.uint32).tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(blob)
    n, m, k, a, b = np.frombuffer(raw, np.int64, 5).tolist()
    at = 40 + 8 * k
    kind = np.dtype(np.uint16 if k < 1 << 16 else np.uint32)
    index = np.frombuffer(raw, kind, n * m, at)
    values = np.frombuffer(raw, np.uint32, a * b, at + index.nbytes)
    return np.frombuffer(raw, U64, k, 40), index.reshape(n, m), values.reshape(a, b)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of several blobs over one dictionary."""
    parts = [_unpack(b) for b in blobs]
    words, _, back = distinct(np.concatenate([p[0] for p in parts]))
    places = np.split(back, np.cumsum([len(p[0]) for p in parts])[:-1])
    columns = np.concatenate([place[index] for place, (_, index, _) in zip(places, parts, strict=True)], axis=1)
    return words, columns, np.concatenate([p[2] for p in parts], axis=1)


def _slot(context: np.ndarray) -> np.ndarray:
    return (context >> U64(8)).astype(np.int64) % HOT_SLOTS


def placing(gram: np.ndarray, context: np.ndarray, hot: bytes) -> np.ndarray:
    """The hash that decides an n-gram's block."""
    return np.where(np.frombuffer(hot, bool)[_slot(context)], gram, context)


def _by_block(block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(an order by block, where each block starts in it); short numbers are sorted by their digits."""
    order = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1))


def _rows(kind: int, block: np.ndarray, words: np.ndarray, columns: np.ndarray, values: np.ndarray, blocks: int):
    """(kind, block, packed, None) of n-grams and values by their blocks."""
    # inside a block in order of their first words, as far as one number has room for them: rows compress better so
    wide, bits = len(words).bit_length(), len(block).bit_length()
    spare, key = 64 - blocks.bit_length() - bits, block.astype(U64)
    for column in columns[:2]:
        kept = min(wide, spare)
        spare, key = spare - kept, key << U64(kept) | column.astype(U64) >> U64(wide - kept)
    key = key << U64(bits) | np.arange(len(block), dtype=U64)
    key.sort()
    order = (key & U64((1 << bits) - 1)).view(np.int64)
    edges = np.searchsorted(block[order], np.arange(blocks + 1))
    columns, values = columns[:, order], values[:, order]
    return [(kind, k, _pack(words, columns[:, edges[k] : edges[k + 1]], values[:, edges[k] : edges[k + 1]]), None) for k in np.flatnonzero(np.diff(edges)).tolist()]


def _grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, an order by hash, where each hash starts in it)."""
    order, h = sort_hashes(h)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    return h[first], order, first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def _batches(rows: list[tuple]):
    for k in range(0, len(rows), 64):
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)], names=["kind", "block", "packed", "stats"])


def _local(folder: str) -> str | None:
    """The folder as a mounted path, if it is one."""
    return folder.removeprefix("file://").removeprefix("file:") if folder.startswith(("file:", "/")) else None


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a byte for each row of values, the rows that bytes below 255 stand for, where the others are)."""
    width = values.shape[1]
    short = np.flatnonzero((values < 1 << 16).all(1))
    packed = (values[short].astype(U64) << (np.arange(width, dtype=U64) * U64(16))).sum(1, dtype=U64)
    coded = pa.array(packed).dictionary_encode()
    known, back = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    times = np.bincount(back, minlength=len(known))
    common = np.lexsort((known, -times))[:255]
    code = np.full(len(known), 255, np.uint8)
    code[common] = np.arange(len(common))
    codes = np.full(len(values), 255, np.uint8)
    codes[short] = code[back]
    table = (known[common][:, None] >> (np.arange(width, dtype=U64) * U64(16)) & U64(0xFFFF)).astype(np.uint32)
    return codes, table, np.flatnonzero(codes == 255)


def _write(folder: str, name: str, keys: np.ndarray, values: np.ndarray) -> None:
    """A block's sorted hashes and their rows of values as one flat file, complete or absent: a repeated task writes the same
    bytes under the same name.

    The leading bits of a hash are implied by an index of where they begin, about 24 hashes an entry; 40 bits follow. Rows of
    values are a byte each, for the 255 most frequent ones; the rest are listed by place.
    """
    n, width = values.shape
    bits = min(16, max(0, n.bit_length() - 5))
    bucket = keys >> U64(64 - bits) if bits else np.zeros(n, U64)
    rest = keys >> U64(24 - bits) & U64((1 << 40) - 1)
    codes, table, others = _coded(values)
    head = np.array([n, width, bits, len(table), len(others)], np.int64)
    parts = [head, np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=U64)).astype(np.uint32), (rest >> U64(8)).astype(np.uint32), table, others.astype(np.uint32), values[others].astype(np.uint32)]
    parts += [rest.astype(np.uint8), codes]
    where, root = (fs.LocalFileSystem(), _local(folder)) if _local(folder) else fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    passing = f"{root}/.{uuid.uuid4().hex}"
    with where.open_output_stream(passing) as f:
        for part in parts:
            f.write(np.ascontiguousarray(part).tobytes())
    where.move(passing, f"{root}/{name}")


class Table:
    """One mapped file of sorted hashes."""

    def __init__(self, raw: np.ndarray):
        raw = raw.view(np.ndarray)
        n, self.width, bits, known, others = raw[:40].view(np.int64).tolist()
        at = 40

        def part(size: int, kind=np.uint32):
            nonlocal at
            at += size * np.dtype(kind).itemsize
            return raw[at - size * np.dtype(kind).itemsize : at].view(kind)

        self.bits = bits
        self.index, self.high = part((1 << bits) + 1), part(n)
        #: the rows that codes stand for; below them one of zeros for unknown hashes
        self.table = np.zeros((257, self.width), np.uint32)
        self.table[:known] = part(known * self.width).reshape(known, self.width)
        self.others, self.rows = part(others), part(others * self.width).reshape(others, self.width)
        self.low, self.codes = part(n, np.uint8), part(n, np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of values of the hashes, zeros for unknown ones: binary search between an index entry and the next."""
        if not len(self.low):
            return np.zeros((len(h), self.width), np.uint32)
        bucket = (h >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        rest = h >> U64(24 - self.bits) & U64((1 << 40) - 1)
        high, low = (rest >> U64(8)).astype(np.uint32), rest.astype(np.uint8)
        place, end = self.index[bucket].astype(np.int64), self.index[bucket + 1].astype(np.int64)
        longest = int((end - place).max(initial=0))
        # the last place that is known to hold less
        place -= 1
        for step in reversed([1 << k for k in range(longest.bit_length())]):
            ahead = place + step
            fewer = self.high.take(ahead, mode="clip") < high
            fewer &= ahead < end
            place += fewer * step
        place += 1
        equal = self.high.take(place, mode="clip") == high
        equal &= place < end
        hit = self.low.take(place, mode="clip") == low
        hit &= equal
        # the few that agree in the first 32 bits only look at the next ones
        asked = np.flatnonzero(equal & ~hit)
        while len(asked):
            place[asked] += 1
            asked = asked[place[asked] < end[asked]]
            asked = asked[self.high[place[asked]] == high[asked]]
            found = self.low[place[asked]] == low[asked]
            hit[asked[found]] = True
            asked = asked[~found]
        code = np.where(hit, self.codes.take(place, mode="clip"), np.uint16(256))
        out = self.table.take(code, axis=0)
        listed = np.flatnonzero(code == 255)
        out[listed] = self.rows[np.searchsorted(self.others, place[listed])]
        return out


def _mapped(folder: str, name: str) -> Table:
    root = _local(folder)
    if root:
        return Table(np.memmap(f"{root}/{name}", np.uint8, "r"))
    where, root = fs.FileSystem.from_uri(folder)
    handle, path = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as out, where.open_input_stream(f"{root}/{name}") as f:
            while part := f.read(1 << 22):
                out.write(part)
        return Table(np.memmap(path, np.uint8, "r"))
    finally:
        os.unlink(path)


def _merge(rows: DataFrame, folder: str, blocks: int, order: int, hot: bytes) -> DataFrame:
    """Merges each (kind, block): writes its files; passes on continuations, context sums and statistics."""

    def finish(kind: int, block: int, blobs: list[bytes]):
        words, columns, values = _joined(blobs)
        if kind == RAW or kind < CONTEXT:
            h, ranked, first = _grouped(gram_hashes(words, columns))
            columns, count = columns[:, ranked[first]], _sums(values[0, ranked], first)
            _write(folder, f"{kind}-{block}", h, count[:, None])
            stats = [int((count == k).sum()) for k in (1, 2, 3, 4)] + [len(count), int(count.sum())]
            yield (kind, -1, None, stats)
            if 1 < kind < CONTEXT:
                g, ranked, first = _grouped(gram_hashes(words, columns[1:]))
                n = np.diff(np.append(first, len(ranked)))
                yield from _rows(kind - 1, block_of(g, blocks), words, columns[1:, ranked[first]], n[None], blocks)
                g, ranked, first = _grouped(gram_hashes(words, columns[:-1]))
                count = count[ranked]
                n = np.stack([_sums(x, first) for x in (count, count == 1, count == 2, count >= 3)])
                # of the highest order a block has all followers of a context that isn't hot
                part = np.frombuffer(hot, bool)[_slot(g)] if kind == order else np.ones(len(g), bool)
                if not part.all():
                    _write(folder, f"{CONTEXT + kind}-{block}", g[~part], n[:, ~part].T)
                if part.any():
                    g, n = g[part], n[:, part]
                    yield from _rows((HOT if kind == order else CONTEXT) + kind, block_of(g, blocks), g, np.arange(len(g))[None], n, blocks)
        else:
            h, ranked, first = _grouped(words[columns[0]])
            _write(folder, f"{kind}-{block}", h, np.stack([_sums(v[ranked], first) for v in values]).T)

    @arrowio.lean
    def run(batches):
        key, held = None, []
        for batch in batches:
            for kind, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (kind, block) != key:
                    if key:
                        yield from _batches(list(finish(*key, held)))
                    key, held = (kind, block), []
                held.append(blob.as_py())
        if key:
            yield from _batches(list(finish(*key, held)))

    dealt = rows.where("block >= 0").select("kind", "block", "packed").repartition(max(1, blocks), "kind", "block").sortWithinPartitions("kind", "block")
    out = dealt.mapInArrow(run, SCHEMA)
    return arrowio.stage(out.withColumn("part", F.when(F.col("block") >= 0, F.col("block") % PASSES).otherwise(-1)), "part")


def _discounts(n: list[int]) -> tuple[float, float, float]:
    if not all(n[:4]):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    found = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


def sized(docs: DataFrame, order: int) -> tuple[int, bytes]:
    """(number of blocks, flags of the hash ranges of contexts that hold over half a block's share of all n-grams), in one pass."""

    def count(ids, texts):
        tokens, _ = tokens_of(texts, order)
        n = np.bincount(_slot(grams(tokens, order - 1, 0)), minlength=HOT_SLOTS) if order > 1 else np.zeros(1, np.int64)
        slots = np.flatnonzero(n)
        return pa.array(np.append(slots, -1), pa.int32()), pa.array(np.append(n[slots], sum(len(t or b"") for t in texts)), pa.int64())

    sums = arrowio.map_chunks(docs, count, "slot int, n long", FLUSH).groupBy("slot").agg(F.sum("n").alias("n")).collect()
    held = {r.slot: r.n for r in sums}
    blocks = 1 + held.pop(-1, 0) // BLOCK
    flags, everything = np.zeros(HOT_SLOTS, bool), sum(held.values())
    flags[[slot for slot, n in held.items() if n * 2 * blocks > everything]] = blocks > 1
    return blocks, flags.tobytes()


def fit(docs: DataFrame, order: int = 3) -> Model:
    """Learns from every row of (doc_id, text)."""
    folder = f"{arrowio.shared_folder(docs.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    blocks, hot = sized(docs, order)

    def counts_of(step: int):
        def count(ids, texts):
            tokens, at = tokens_of(texts, order)
            g = grams(tokens, order, 0)
            inside = np.ones(len(g), bool)
            for k in range(order - 1):
                late = at[1:-1] - 1 - k
                inside[late[late < len(g)]] = False
            place = placing(g, grams(tokens, order - 1, 0)[: len(g)], hot) if order > 1 else g
            block = block_of(place, blocks)
            words, _, index = distinct(tokens)
            where = np.flatnonzero(inside & (block % PASSES == step))
            _, ranked, first = _grouped(g[where])
            n, where = np.diff(np.append(first, len(ranked))), where[ranked[first]]
            rows = _rows(order, block[where], words, np.stack([index[where + k] for k in range(order)]), n[None], blocks)
            if not step:
                n = np.bincount(index[np.flatnonzero(inside) + order - 1], minlength=len(words))
                mine = np.flatnonzero(n)
                rows += _rows(RAW, block_of(gram_hashes(words, mine[None]), blocks), words, mine[None], n[None, mine], blocks)
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]

        return arrowio.map_chunks(docs, count, SCHEMA, FLUSH)

    model = Model(order, folder, blocks, hot=hot)
    above: list[DataFrame] = []
    for level in range(order, 0, -1):
        # a part of the blocks at a time, so that only their rows are shuffled and on disk at once
        if level == order:
            parts = [counts_of(step) for step in range(PASSES)]
        else:
            rows = functools.reduce(DataFrame.union, above).where(F.col("kind") == level)
            parts = [rows.where(F.col("part") == step) for step in range(PASSES)]
        staged = []
        for step, part in enumerate(parts):
            staged.append(_merge(part, folder, blocks, order, hot))
            for done in above:
                arrowio.drop_stage(done, f"part={step}")
        for done in above:
            arrowio.drop_stage(done)
        above = staged
        merged = functools.reduce(DataFrame.union, above)
        sums = merged.where("block < 0").groupBy("kind").agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(6))).collect()
        for r in sums:
            n = [r[f"s{k}"] for k in range(6)]
            if r.kind == RAW:
                model.vocabulary, model.tokens = n[4], n[5]
            else:
                model.discounts[r.kind] = _discounts(n)
                if r.kind == 1:
                    model.unigrams = (n[5], n[0], n[1], n[4] - n[0] - n[1])
        if level > 1:
            contexts = merged.where(F.col("kind").isin(CONTEXT + level, HOT + level))
            arrowio.drop_stage(_merge(contexts, folder, blocks, order, hot))
    for done in above:
        arrowio.drop_stage(done)
    return model


class Arrays:
    """The model's files, mapped when first asked for."""

    def __init__(self, model: Model):
        self.model, self.held = model, {}

    def deal(self, asked: np.ndarray, back: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct, sorted hashes in order of their blocks, where each block starts, ``back`` for that order).

        place: what decides the block, where it isn't the hash.
        """
        order, edges = _by_block(block_of(asked if place is None else place, self.model.blocks), self.model.blocks)
        now = np.empty(len(order), np.uint32)
        now[order] = np.arange(len(order), dtype=np.uint32)
        return asked[order], edges, now[back]

    def find(self, kind: int, asked: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Values of dealt hashes, (number, width); zeros for unknown ones."""
        out = np.zeros((len(asked), 4 if CONTEXT <= kind < RAW else 1), np.uint32)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            if (kind, k) not in self.held:
                try:
                    self.held[kind, k] = _mapped(self.model.folder, f"{kind}-{k}")
                except FileNotFoundError:
                    self.held[kind, k] = None
            if self.held[kind, k]:
                out[edges[k] : edges[k + 1]] = self.held[kind, k].find(asked[edges[k] : edges[k + 1]])
        return out


@functools.lru_cache(2)
def _arrays(folder: str, order: int, blocks: int) -> Arrays:
    return Arrays(Model(order, folder, blocks))


def _less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)], 0)


def probabilities(tokens: np.ndarray, where: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(probability, training count) of the tokens at the places ``where``, each after the order - 1 before it.

    Each distinct n-gram of the run is looked up once, as an n-gram and as the context of longer ones.
    """
    arrays = _arrays(model.folder, model.order, model.blocks)
    words, _, back = distinct(tokens)
    asked = grams(words, 1, 0)
    shorter = asked[back]
    ranked, asked = sort_hashes(asked)
    place_of = np.empty(len(asked), np.uint32)
    place_of[ranked] = np.arange(len(asked), dtype=np.uint32)
    asked, edges, back = arrays.deal(asked, place_of[back])
    own = back[where]
    raw = arrays.find(RAW, asked, edges)[:, 0][own].astype(float)
    total, *followers = model.unigrams
    p = np.full(len(asked), 1.0 / (model.vocabulary + 1))
    if total:
        d = model.discounts[1]
        c = arrays.find(1, asked, edges)[:, 0].astype(float)
        p = _less(c, d) / total + sum(x * n for x, n in zip(d, followers, strict=True)) / total * p
    p = p[own]
    any_hot = any(model.hot)
    for k in range(2, model.order + 1):
        if k not in model.discounts:
            break
        d, top = model.discounts[k], k == model.order
        seen = arrays.find(CONTEXT + k, asked, edges)
        if top and any_hot:
            seen = seen + arrays.find(HOT + k, asked, edges)
        total = np.maximum(seen[:, 0], 1).astype(float)
        passed_on = np.where(seen[:, 0] > 0, seen[:, 1:] @ np.array(d) / total, 1.0)
        context = back[where - k + 1]
        gram = grams(tokens, k, 0)
        asked, first, back = distinct(gram)
        asked, edges, back = arrays.deal(asked, back, placing(asked, shorter[first], model.hot) if top else None)
        c = arrays.find(k, asked, edges)[:, 0][back[where - k + 1]].astype(float)
        # an unseen context has no seen n-gram
        p = _less(c, d) / total[context] + passed_on[context] * p
        shorter = gram
    return p, raw


SCORE_SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probabilities), perplexity of every row of (doc_id, text)."""

    def kernel(ids, texts):
        tokens, at = tokens_of(texts, model.order)
        inside = np.ones(len(tokens), bool)
        for k in range(model.order - 1):
            inside[at[:-1] + k] = False
        where = np.flatnonzero(inside)
        sizes = np.diff(at) - model.order + 1
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        p, raw = probabilities(tokens, where, model)
        base = np.add.reduceat(np.log10((raw + 1) / (model.tokens + model.vocabulary + 1)), first)
        own = np.add.reduceat(np.log10(p), first)
        known = np.add.reduceat((raw > 0).astype(np.int64), first)
        columns = (ids, sizes, known, base, own, 10 ** np.minimum(-own / sizes, 300))
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)]

    return arrowio.map_chunks(docs, kernel, SCORE_SCHEMA, RUN)


def op6_kneser_ney(spark, sf_dir: str, order: int = 3) -> DataFrame:
    docs = arrowio.documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = fit(arrowio.id_text(docs.where(~held_out)), order)
    scored = score(arrowio.id_text(docs), model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
