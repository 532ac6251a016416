"""Secret scanning: fixed patterns plus compression novelty measured by dictionary-primed zstandard.

``base_spans`` finds the three fixed kinds. ``novel_spans`` looks at every other token-like run of characters that
stands in a sensitive context (any of ``CONTEXT`` words ends up to ``REACH`` characters before it on its line): its
marginal cost is the compressed size of surrounding text plus candidate less that of the surrounding text alone, both
by a zstandard compressor primed with a dictionary of identifiers and code; a candidate that costs at least
``NOVELTY`` of its own bytes and mixes character classes is reported as kind ``novel``. Spans are code points, end
exclusive. A candidate that overlaps a base span isn't reported again. Null text counts as empty; texts are scanned
whole; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sessionloom.llm import arrowio

KINDS = ("assign", "access", "hex", "novel")
_LETTERS = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(f"({'|'.join(map(_LETTERS, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

CONTEXT = ("auth", "bearer", "cred", "key", "passphrase", "passwd", "password", "private", "pwd", "secret", "sig", "token")
REACH, AROUND = 40, 256
NOVELTY, SHORTEST = 0.75, 16
_CONTEXT = re.compile(f"(?:{'|'.join(map(_LETTERS, CONTEXT))})[A-Za-z_-]*[^A-Za-z0-9\n](?=([^\n]{{0,{REACH}}}))")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{SHORTEST},}}")

#: What ordinary code and configuration is made of: text that should cost nothing.
IDENTIFIERS = (
    "abstract async await boolean break class const continue default define delete double else enum export extends false final "
    "finally float for from function global if implements import include instanceof int interface lambda let long module new null "
    "None package pass private protected public raise return self short signed static string struct super switch this throw true "
    "try type typedef union unsigned using var void volatile while with yield "
    "username password passwd secret token api_key access_key private_key public_key client_id client_secret authorization bearer "
    "session_id request response header content_type application/json text/html utf-8 localhost 127.0.0.1 http://www.example.com/ "
    "https://api.example.org/v1/ config settings environment variable database connection string host port user example sample test "
    "placeholder changeme your-token-here xxxxxxxxxxxxxxxx 0123456789abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "def __init__(self, name, value): return self.value = value if value is not None else default "
    "public static void main(String[] args) { System.out.println(); } function (error, result) { return callback(null, result); } "
    "SELECT * FROM table WHERE id = ? ORDER BY name; #include <stdio.h> int main(int argc, char **argv) { return 0; } "
).encode()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed kinds, by start, then kind as listed."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


@functools.lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end], given the text around it, by its own bytes."""
    around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode()
    candidate = text[start:end].encode()
    cost = len(_compressor().compress(around + candidate)) - len(_compressor().compress(around))
    return cost / max(1, len(candidate))


def novel_spans(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    done = 0
    for line in _CONTEXT.finditer(text):
        at = max(done, line.start(1))
        # a run that starts in reach is judged whole, and once, however many context words reach it
        while found := _CANDIDATE.search(text, at, line.end(1) + SHORTEST):
            start, end = _CANDIDATE.match(text, found.start()).span()
            at = done = end
            value = text[start:end]
            mixed = sum(any(map(f, value)) for f in (str.islower, str.isupper, str.isdigit)) >= 2
            if mixed and not any(a < end and start < b for a, b, _ in known) and novelty(text, start, end) >= NOVELTY:
                out.append((start, end, "novel"))
    return out


def all_spans(text: str | None) -> list[tuple[int, int, str]]:
    base = base_spans(text or "")
    return sorted(base + novel_spans(text or "", base), key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each span: doc_id, kind, start, end, value, novelty."""

    def kernel(ids, texts):
        rows = []
        for key, raw in zip(ids, texts, strict=True):
            text = (raw or b"").decode()
            rows += [(key, k, a, b, text[a:b], novelty(text, a, b)) for a, b, k in all_spans(text)]
        if not rows:
            return None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]

    return arrowio.map_chunks(arrowio.id_text(docs), kernel, "doc_id long, kind string, start long, end long, value string, novelty double")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of the base spans, all spans as text."""

    def kernel(ids, texts):
        rows = []
        for key, raw in zip(ids, texts, strict=True):
            spans = all_spans((raw or b"").decode())
            base = [s for s in spans if s[2] != "novel"]
            counts = [sum(s[2] == k for s in base) for k in KINDS[:3]]
            rows.append((key, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]

    return arrowio.map_chunks(arrowio.id_text(docs), kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by ``<secret>``; null text stays null."""
    names, at = docs.columns, docs.columns.index(text_col)

    @arrowio.lean
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    done, parts = 0, []
                    for a, b, _ in all_spans(text):
                        if b > done:
                            parts += [text[done:a], "<secret>"] if a >= done else []
                            done = b
                    text = "".join(parts) + text[done:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(arrowio.documents(spark, sf_dir))
