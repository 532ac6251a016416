"""Removal of repeated word passages: exact window counting by super-k-mer partitioning.

A window is ``window`` consecutive words of a document. Its minimiser is the smallest hash among its runs of ``M`` words.
Consecutive windows of one minimiser are a super-k-mer: they travel as one packed string of their words, with document and
first position, to the bucket of the minimiser, so equal windows of any two documents meet in one bucket and a passage
is sent about three times instead of ``window`` times. In a bucket the windows are laid out in order of (document,
position) and sorted by content, which puts the first occurrence of each first: every other one, if it starts later, is a
repeat. Words covered by a repeat go.

Skew: a map task sends one of the equal super-k-mers that it has seen and marks the others itself, so a passage held by a
third of all documents costs its bucket one packed string a flush. A bucket's strings stay compressed in memory and are
worked through in ``PASSES`` passes by minimiser.

The order is (doc_id, start), strictly: rows of equal doc_id and text are equally early and keep the same words. Rows of
null doc_id come after all others, in order of a hash of their text. Null text has no words. Documents under ``window`` words stay whole. An empty table
gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import arrowio
from sessionloom.llm.textwords import U64, Words, grams, mix, powers, window_grams

WINDOW, M = 20, 3
#: Bytes of text a map task gathers before it sends, and bytes of the whole corpus for each bucket.
FLUSH, BUCKET, PASSES = 8 << 20, 4 << 20, 4
#: Buckets that one task works through, one after another.
TASK = 4
_BASE = 0x2545F4914F6CDD1D


def _running(h: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(_BASE, len(h)), out=total[1:])
    return total


def run_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the words a..b-1 for arrays of bounds; the same words give the same hash wherever they stand."""
    total = _running(h)
    inverse = powers(pow(_BASE, -1, 1 << 64), len(h) + 1)
    return mix((total[b] - total[a]) * inverse[a] + mix((b - a).astype(U64)))


def text_keys(words: Words, h: np.ndarray) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    return run_hashes(h, words.first[:-1], words.first[1:]).astype(np.int64)


def row_keys(words: Words, h: np.ndarray, nameless: np.ndarray) -> np.ndarray:
    """32 bits that tell rows of one number apart: the highest for a null doc_id, then bits of the words' hash."""
    return text_keys(words, h) & 0x7FFFFFFF | nameless.astype(np.int64) << 31


def super_kmers(words: Words, h: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window (by word number) and mixed minimiser of each super-k-mer."""
    n = len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    least = grams(h, m, 77)
    width, have = window - m + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    owner = words.owner()
    inside = owner[:n] == owner[window - 1 :]
    change = np.ones(n, bool)
    change[1:] = (least[1:n] != least[: n - 1]) | (owner[1:n] != owner[: n - 1]) | ~inside[: n - 1]
    starts = np.flatnonzero(change & inside)
    stops = np.flatnonzero(inside & np.append(change[1:] | ~inside[1:], True))
    # minima crowd at small hashes; mixed again they spread over the buckets
    return starts, stops, mix(least[starts])


class Outbox:
    """Super-k-mers on their way to buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.bytes = buckets, [], 0

    def add(self, ids: list, texts: list[bytes | None], window: int, m: int) -> None:
        words = Words(texts)
        h = words.hashes()
        a, b, least = super_kmers(words, h, window, m)
        self.bytes += len(words.data)
        if not len(a):
            return
        owner = np.searchsorted(words.first, a, side="right") - 1
        numbers = np.array([i["number"] for i in ids], np.int64)[owner]
        keys = row_keys(words, h, np.array([i["nameless"] for i in ids], bool))[owner]
        same = run_hashes(h, a, b + window)
        self.held.append((numbers, a - words.first[owner], b - a + 1, keys, least, same, words.starts[a], words.ends[b + window - 1], words.blob))

    def flush(self, window: int) -> list[tuple[int, bytes]]:
        """(bucket, blob) rows; bucket -1 holds the spans that repeat an earlier super-k-mer of this flush."""
        if not self.held:
            self.bytes = 0
            return []
        numbers, at, count, keys, least, same, begin, end = (np.concatenate([x[k] for x in self.held]) for k in range(8))
        source = np.repeat(np.arange(len(self.held)), [len(x[0]) for x in self.held])
        blobs = [x[8] for x in self.held]
        self.held, self.bytes = [], 0
        nameless = keys >> 31
        order = np.lexsort((at, numbers, nameless, same))
        first = np.ones(len(order), bool)
        first[1:] = same[order][1:] != same[order][:-1]
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        later = (nameless[order] != nameless[lead]) | (numbers[order] != numbers[lead]) | (at[order] > at[lead])
        repeat = order[~first & later]
        rows = []
        if len(repeat):
            rows.append((-1, np.stack((numbers[repeat], keys[repeat], at[repeat], at[repeat] + count[repeat] + window - 1)).astype(np.int64).tobytes()))
        # rows of one doc_id may tie for the first place: each of them goes on, so that all get the same verdict
        send = order[first | ~later]
        send.sort()
        # in order of bucket, then pass, then document
        bucket = ((least[send] >> U64(32)) * U64(self.buckets) >> U64(32)).astype(np.int64)
        turn = ((least[send] & U64(0xFFFF)) % U64(PASSES)).astype(np.int64)
        by = np.argsort(bucket * PASSES + turn, kind="stable")
        send, bucket, turn = send[by], bucket[by], turn[by]
        edges = np.searchsorted(bucket * PASSES + turn, np.arange(self.buckets * PASSES + 1)).tolist()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for k in np.unique(bucket).tolist():
            part = send[edges[k * PASSES] : edges[(k + 1) * PASSES]]
            texts = [blobs[s][x:y] for s, x, y in zip(source[part].tolist(), begin[part].tolist(), end[part].tolist(), strict=True)]
            upto = np.array(edges[k * PASSES : (k + 1) * PASSES + 1], np.int64) - edges[k * PASSES]
            head = (upto, numbers[part].astype(np.int64), at[part].astype(np.int32), np.fromiter(map(len, texts), np.int32, len(texts)), keys[part].astype(np.uint32))
            rows.append((k, squeeze(b"".join(x.tobytes() for x in head) + b"".join(texts))))
        return rows


def bucket_repeats(blobs: list[bytes], window: int) -> list[np.ndarray]:
    """Spans (doc, key, from, to), one array a pass, of the windows of a bucket that start earlier elsewhere."""
    out = []
    for turn in range(PASSES):
        heads, texts = [], []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(blob)
            upto = np.frombuffer(raw, np.int64, PASSES + 1)
            n, mine = int(upto[-1]), slice(int(upto[turn]), int(upto[turn + 1]))
            base = upto.nbytes
            sizes = np.frombuffer(raw, np.int32, n, base + 12 * n).astype(np.int64)
            ends = np.cumsum(sizes) + base + 20 * n
            texts += [raw[e - s : e] for e, s in zip(ends[mine].tolist(), sizes[mine].tolist(), strict=True)]
            heads.append(np.stack((np.frombuffer(raw, np.int64, n, base)[mine], np.frombuffer(raw, np.int32, n, base + 8 * n)[mine], np.frombuffer(raw, np.uint32, n, base + 16 * n)[mine])))
        if not texts:
            continue
        doc, at, key = np.concatenate(heads, axis=1)
        order = np.lexsort((at, doc, key >> 31))
        doc, at, key = doc[order], at[order], key[order]
        words = Words([texts[k] for k in order.tolist()])
        del texts
        h = words.hashes()
        sizes = np.diff(words.first) - window + 1
        mine = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(mine)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        where = words.first[:-1][mine] + offset
        one, two = window_grams(h, window, 1)[where], window_grams(h, window, 2)[where]
        ranked = np.argsort(one, kind="stable")
        if np.any((one[ranked][1:] == one[ranked][:-1]) & (two[ranked][1:] != two[ranked][:-1])):
            ranked = np.lexsort((np.arange(len(one)), two, one))
        a, b = one[ranked], two[ranked]
        first = np.ones(len(ranked), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lead = ranked[np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))]
        place = at[mine] + offset
        flagged = np.zeros(len(ranked), bool)
        flagged[ranked] = ~first & ((key[mine[ranked]] >> 31 != key[mine[lead]] >> 31) | (doc[mine[ranked]] != doc[mine[lead]]) | (place[ranked] > place[lead]))
        # consecutive flagged windows of a string are one span
        begins = flagged & ~(np.append(False, flagged[:-1]) & (offset > 0))
        stops = flagged & ~(np.append(flagged[1:], False) & (np.append(offset[1:], 0) > 0))
        s, e = np.flatnonzero(begins), np.flatnonzero(stops)
        if len(s):
            out.append(np.stack((doc[mine[s]], key[mine[s]], place[s], place[e] + window)))
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """(doc_id, key, spans): the word spans of each document that repeat earlier text, as packed (from, to) pairs.

    docs: (id: struct of number and nameless, text). doc_id is the number; key has ``row_keys``.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // BUCKET

    @arrowio.lean
    def send(batches):
        box = Outbox(buckets)
        for ids, texts in arrowio.chunks(batches):
            box.add(ids, texts, window, m)
            if box.bytes >= FLUSH:
                yield from emit(box)
        yield from emit(box)

    def emit(box):
        for k in range(0, len(rows := box.flush(window)), 64):
            part = rows[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], names=["bucket", "packed"])

    def spans_batch(arrays):
        doc, key, a, b = np.concatenate(arrays, axis=1)
        order = np.lexsort((a, key, doc))
        doc, key, a, b = doc[order], key[order], a[order], b[order]
        at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))))
        both = np.stack((a, b), axis=1).astype(np.int32)
        packed = [both[x:y].tobytes() for x, y in zip(at.tolist(), [*at[1:].tolist(), len(doc)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(key[at], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "key", "spans"])

    @arrowio.lean
    def count(batches):
        bucket, held = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k < 0:
                    yield spans_batch([np.frombuffer(blob.as_py(), np.int64).reshape(4, -1)])
                    continue
                if k != bucket:
                    for found in bucket_repeats(held, window):
                        yield spans_batch([found])
                    bucket, held = k, []
                held.append(blob.as_py())
        for found in bucket_repeats(held, window):
            yield spans_batch([found])

    # a task gets a range of buckets, in order; what needs no bucket goes anywhere
    tasks = 1 + (buckets - 1) // TASK
    to = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("packed"), F.lit(tasks))).otherwise(F.floor(F.col("bucket") / TASK)).cast("int")
    sent = docs.mapInArrow(send, "bucket int, packed binary").repartitionById(tasks, to).sortWithinPartitions("bucket")
    return sent.mapInArrow(count, "doc_id long, key long, spans binary")


def _with_spans(docs: DataFrame, window: int, m: int) -> DataFrame:
    """docs (number, text and others) with the packed spans of each row, null without any."""
    # rows without an id go by their text, after all others
    numbered = docs.withColumns({"__number": F.coalesce("__id", F.xxhash64("__text")), "__nameless": F.col("__id").isNull()})
    read = numbered.select(F.struct(F.col("__number").alias("number"), F.col("__nameless").alias("nameless")).alias("id"), F.col("__text").alias("text"))
    found = arrowio.stage(repeated_spans(read, window, m))
    spans = found.groupBy("doc_id", (F.shiftright("key", 31) == 1).alias("of_nameless")).agg(F.collect_set(F.struct("key", "spans")).alias("__spans"))
    return numbered.join(spans, (F.col("__number") == F.col("doc_id")) & (F.col("__nameless") == F.col("of_nameless")), "left").select(*docs.columns, "__spans")


def kept_words(text: bytes | None, spans: list | None, words: Words | None = None) -> tuple[int, list[bytes]]:
    """How many words the text has, and those that no span covers. spans: of all rows of this doc_id, with their keys."""
    if not spans:
        all_words = (text or b"").split()
        return len(all_words), all_words
    words = Words([text])
    key = int(text_keys(words, words.hashes())[0]) & 0x7FFFFFFF
    keep = np.ones(len(words.starts) + 1, np.int64)
    keep[:] = 0
    for s in spans:
        if s["key"] & 0x7FFFFFFF == key:
            both = np.frombuffer(s["spans"], np.int32).reshape(-1, 2)
            np.add.at(keep, both[:, 0], 1)
            np.add.at(keep, both[:, 1], -1)
    left = np.flatnonzero(np.cumsum(keep)[:-1] == 0)
    return len(words.starts), [words.blob[a:b] for a, b in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)]


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"__id": F.col(id_col).cast("long"), "__text": F.col(text_col).cast("string")})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = M) -> DataFrame:
    """The same rows and columns without the repeated words; a text that loses some is its kept words joined by one space."""
    names = docs.columns
    renamed = docs.toDF(*(f"c{k}" for k in range(len(names))))
    marked = _marked(renamed, f"c{names.index(id_col)}", f"c{names.index(text_col)}")
    joined = _with_spans(marked, window, m).select(*renamed.columns, "__spans")
    at, plain = names.index(text_col), renamed.columns

    @arrowio.lean
    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(len(names)).to_pylist(), strict=True):
                value = text.as_py()
                if spans and value is not None:
                    n, kept = kept_words(value.encode(), spans)
                    value = value if n == len(kept) else b" ".join(kept).decode()
                texts.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=plain)

    return joined.mapInArrow(run, renamed.schema).toDF(*names)


def digest(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    read = arrowio.id_text(docs)
    joined = _with_spans(_marked(read.toDF("n", "t"), "n", "t"), window, m).select("__id", "__text", "__spans")

    @arrowio.lean
    def run(batches):
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
                n, kept = kept_words(text.as_py(), spans)
                rows.append((key, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(arrowio.documents(spark, sf_dir))
