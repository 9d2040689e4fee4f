import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from quarrylog.llm import quality

from .test_operators import plain_score

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    every = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == COLUMNS
        kept = docs.collect()
        assert len({r.doc_id for r in kept}) == len(kept) and {r.doc_id for r in kept} <= every
        assert all(r.n_chars == len(r.text) for r in kept)
        every = {r.doc_id for r in kept}
        docs = spark.createDataFrame(kept, docs.schema)
    assert len(every) > 100
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == every


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, "b", 0), (None, "some text here", "en", None, 14), (3, "again", "en", "a", 5), (3, "again", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
    assert docs.count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(rows)


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables(spark, stage):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SMALL).count() == 0


def by_hand(spark):
    """The pipeline over the smallest tables in plain Python: {doc_id: ids} of what is packed."""
    from tokenizers import Tokenizer

    rows = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality is not None}
    crc = lambda d: zlib.crc32(str(d).encode())
    learnt = sorted((r for r in rows if r.doc_id in labels and crc(r.doc_id) % 4 != 2), key=lambda r: crc(r.doc_id))
    model = quality.train([(r.text, labels[r.doc_id]) for r in learnt])
    held = [(r.doc_id, r.text) for r in rows if plain_score(model, r.text) >= 0.7]

    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate({c: c + 32 for c in range(65, 91)})
    seen = Counter(k for _, t in held for k in {key(x) for x in t.split("\n")})
    held = [(d, "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10)) for d, t in held]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in held]
    label = list(range(len(held)))
    for i in range(len(held)):
        for j in range(i):
            if sets[i] and sets[j] and label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    held = [x for k, x in enumerate(held) if label[k] == k]

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = word.findall(lower(r.text or ""))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes, clean = {len(w) for w in windows}, []
    for d, t in held:
        at = list(word.finditer(lower(t)))
        w, hit = [m[0] for m in at], set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        kept, last = [], 0
        for i in sorted(hit):
            if i - 1 not in hit:
                kept.append(t[last : at[i].start()])
            last = at[i].end()
        clean.append((d, "".join([*kept, t[last:]])))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in clean}


def test_the_whole_pipeline_by_hand(spark):
    expected = by_hand(spark)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(expected)
    filled = {}
    for r in rows:
        ids = expected[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == Counter({d: len(ids) for d, ids in expected.items()})
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_odd_rows_pass_the_classifier(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, "b", 0), (None, "some text here", "en", None, 14), (3, "again", "en", "a", 5), (3, "again", "en", "a", 5), (4, "long " * 300_000, "en", "a", 1_500_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert kept.columns == COLUMNS and {tuple(r) for r in kept.collect()} <= set(rows)
