"""Language identification by multilingual mixture inference.

A model holds, for each language, smoothed probabilities of hashed byte trigrams inside lower-cased words (a word is a run
of letters; digits, punctuation and white space are one border symbol). A document is a mixture of languages whose words
are drawn word by word: expectation-maximisation estimates the proportions from the words' likelihoods, for the one, two,
... languages of the largest shares as long as a further one raises the penalised likelihood (log-likelihood less
``PENALTY`` times half the log of the number of words a further language). The prediction is the language of the
largest proportion and the score that proportion, between 0 and 1.

Training counts every labelled row: trigram counts are summed in each task, then by Spark; at most languages x ``SLOTS``
sums reach the driver. Null text, or text without a letter, is ``und`` with score 0; rows without text or label don't train; without any
training row everything is ``und``. Texts count whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import arrowio
from sessionloom.llm.textwords import U64, mix

SLOTS, SMOOTH = 1 << 16, 0.1
STEPS, PENALTY = 8, 2.0
#: Languages that a model may have; more distinct labels than this are an error.
LANGUAGES = 256

_ASCII_LETTER = re.compile(b"[A-Za-z]")
_SYMBOL = np.zeros(256, np.uint8)
for _c in range(256):
    _SYMBOL[_c] = _c | 32 if chr(_c).isalpha() and _c < 128 else _c if _c >= 128 else 32


def _trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slot of each letter byte, where each word starts among them, and each text's first word (one more at the end)."""
    joined = b" " + b" ".join([t or b"" for t in texts]) + b" "
    data = _SYMBOL[np.frombuffer(joined, np.uint8)]
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1] + 1
    letter = data != 32
    at = np.flatnonzero(letter)
    code = data.astype(np.uint32)
    slots = (mix((code[at - 1] | code[at] << 8 | code[at + 1] << 16).astype(U64)) >> U64(48)).astype(np.int64)
    starts = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    return slots, np.searchsorted(at, starts), np.append(np.searchsorted(starts, begins), len(starts))


def train(rows: DataFrame) -> dict:
    """The model from (lang, text) rows: {"languages": sorted labels, "log": array of languages x SLOTS}."""

    @arrowio.lean
    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                by.setdefault(lang, []).append(text.as_py())
            for lang, texts in by.items():
                for k in range(0, len(texts), 256):
                    held[lang] = held.get(lang, 0) + np.bincount(_trigrams(texts[k : k + 256])[0], minlength=SLOTS)
        for lang, counts in held.items():
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(counts[slots], pa.int64())], names=["lang", "slot", "n"])

    known = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = known.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    labels = table.column("lang").to_pylist()
    languages = sorted(set(labels))
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = np.zeros((len(languages), SLOTS))
    place = {lang: k for k, lang in enumerate(languages)}
    counts[[place[x] for x in labels], table.column("slot").to_numpy()] = table.column("n").to_numpy()
    log = np.log(counts + SMOOTH) - np.log(counts.sum(1, keepdims=True) + SMOOTH * SLOTS)
    return {"languages": languages, "log": log.astype(np.float32)}


def mixtures(texts: list[bytes | None], model: dict) -> list[tuple[dict[str, float], float]]:
    """Each text's languages with their proportions, largest first, and the share of its words that they explain better than
    an even draw of all trigrams does; no language and 0 for a text without a word."""
    languages, log = model["languages"], model["log"]
    slots, word_at, first = _trigrams(texts)
    out: list[tuple[dict[str, float], float]] = [({}, 0.0) for _ in texts]
    have = np.flatnonzero(np.diff(first))
    if not len(have) or not languages:
        return out
    words = np.add.reduceat(log[:, slots].T, word_at, axis=0).astype(np.float64)
    top = words.max(1, keepdims=True)
    chance = np.exp(np.maximum(words - top, -60))
    at, sizes = first[have], np.diff(first)[have].astype(float)
    owner = np.repeat(np.arange(len(have)), np.diff(first)[have])
    base = np.add.reduceat(top[:, 0], at)

    def expect(share: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of the texts ``mine`` after some steps from ``share``."""
        all_ = len(mine) == len(have)
        rows = slice(None) if all_ else np.isin(owner, mine)
        chances, of = chance[rows], owner if all_ else np.repeat(np.arange(len(mine)), sizes[mine].astype(np.int64))
        starts = np.concatenate(([0], np.cumsum(sizes[mine])[:-1])).astype(np.int64)
        for _ in range(STEPS):
            part = chances * share[of]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            share = np.add.reduceat(part, starts, axis=0) / sizes[mine, None]
        return share, base[mine] + np.add.reduceat(np.log(np.maximum((chances * share[of]).sum(1), 1e-300)), starts)

    everyone = np.arange(len(have))
    everything, _ = expect(np.full((len(have), len(languages)), 1 / len(languages)), everyone)
    rank = np.argsort(np.argsort(-everything, axis=1, kind="stable"), axis=1)
    best, likelihood = expect((rank < 1).astype(float), everyone)
    value, asked = likelihood, everyone
    # a further language as long as it pays, text by text
    for k in range(2, len(languages) + 1):
        share, found = expect((rank[asked] < k) / k, asked)
        worth = found - PENALTY * (k - 1) * 0.5 * np.log(sizes[asked] + 1)
        better = worth > value[asked]
        asked = asked[better]
        best[asked], value[asked] = share[better], worth[better]
        if not len(asked):
            break
    letters = np.diff(np.append(word_at, len(slots)))
    word = top[:, 0] + np.log(np.maximum((chance * best[owner]).sum(1), 1e-300))
    known = np.add.reduceat((word > -letters * np.log(SLOTS)).astype(float), at) / sizes
    for k, row, more in zip(have.tolist(), best, known.tolist(), strict=True):
        order = np.argsort(-row, kind="stable")
        out[k] = {languages[j]: min(1.0, float(row[j])) for j in order.tolist() if row[j] > 1e-6}, more
    return out


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode())))


def predictions(texts: list[bytes | None], model: dict) -> list[tuple[str, float, str, float]]:
    """(language or und, score, all proportions as text, share of words explained) of each text."""
    out = []
    for text, (found, known) in zip(texts, mixtures(texts, model), strict=True):
        if not found or not has_letter(text):
            out.append(("und", 0.0, "", 0.0))
        else:
            lang = next(iter(found))
            out.append((lang, found[lang], ",".join(f"{k}:{v:.3f}" for k, v in found.items() if v >= 0.0005), known))
    return out


def _in_fold(mod: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == remainder


def fit_documents(docs: DataFrame) -> dict:
    """Trains on the rows whose crc32(doc_id as text) mod 5 isn't 0."""
    return train(docs.where(~_in_fold(5, 0)).select("lang", "text"))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, mixture of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(ids, texts):
        found = predictions(texts, shared.value)
        return pa.array(ids, pa.int64()), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string())))

    return arrowio.map_chunks(arrowio.id_text(docs), kernel, "doc_id long, lang_pred string, score double, mixture string", 1 << 18)


def keep_identified(docs: DataFrame, model: dict, least: float = 0.25) -> DataFrame:
    """The rows, unchanged, whose text has a language: at least that share of its words is better explained by its mixture than
    by an even draw of all trigrams. Texts of no learned language (random letters) go; a key or a number among words doesn't
    matter."""
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrowio.lean
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = [x.as_py() for x in part.column(at).cast(pa.large_binary())]
                keep = [lang != "und" and known >= least for lang, _, _, known in predictions(texts, shared.value)]
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep)).columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op8_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = arrowio.documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = _in_fold(5, 0).alias("held_out")
    found = predict(docs, fit_documents(docs))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
