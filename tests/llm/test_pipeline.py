"""The pipeline against a brute-force version on a small corpus, and its contract."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sessionloom.llm import language_id, secrets
from tests.llm.test_pairs import jaccard_brute

WORDS = {"aa": ["zun", "dern", "schu", "lich", "ber", "ung", "heit", "kei"], "bb": ["ouel", "tion", "reux", "eaux", "quet", "ment", "aire", "pou"]}


def corpus():
    rng = random.Random(11)
    text = lambda lang, n: " ".join("".join(rng.choices(WORDS[lang], k=3)) for _ in range(n))
    passage = text("aa", 60)
    rows = [[k, text(lang, rng.randint(5, 80)), lang] for k, lang in enumerate(rng.choices(list(WORDS), k=80))]
    rows += [[100 + k, text("aa", 30) + " " + passage + " " + text("aa", 30), "aa"] for k in range(5)]
    rows += [[200 + k, rows[k][1], rows[k][2]] for k in range(10)]
    rows += [[300 + k, rows[k][1] + " zz", rows[k][2]] for k in range(20, 30)]
    rows += [[400, None, "aa"], [401, "## 12", "bb"], [402, "", "aa"], [403, text("bb", 20) + " password=hunter2222 " + text("bb", 5), "bb"]]
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, t, lang in rows]


def brute(rows):
    rows = [r for r in rows if language_id.has_letter((r[1] or "").encode())]
    joined = jaccard_brute([(r[0], r[1]) for r in rows], 5, 80)
    rows = [r for r in rows if joined[r[0]][1] == r[0]]
    first = {}
    words = {r[0]: r[1].encode().split() for r in rows}
    for i, w in words.items():
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = {}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text, *_ in rows:
        w, keep = words[i], [True] * len(words[i])
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                keep[k : k + 20] = [False] * 20
        if not any(keep):
            continue
        text = text if all(keep) else b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()
        for a, b, _ in reversed(secrets.all_spans(text)):
            text = text[:a] + "<secret>" + text[b:]
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        out[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in out} == brute(rows)
    by_sequence = collections.defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
