"""The stages of the corpus pipeline, one after the other, against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.test_dedup import BIG, brute_near  # noqa: E402

SPACE = r"[\x20\x09-\x0D]+"


def last(i):
    return BIG if i is None else i


def brute_exact(rows):
    first = {}
    for i, t, s in rows:
        key = re.sub(SPACE, " ", t or "")
        if key not in first or last(i) < last(first[key][0]):
            first[key] = (i, t, s)
    return list(first.values())


def brute_mix(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    free, budget, target = set(order), 1.5 * sum(sizes.values()), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]} or free
        for s in full:
            target[s] = min(level * weight[s], 2.0 * sizes[s])
        if full == free:
            break
        budget -= sum(target[s] for s in full)
        free = free - full
    served = []
    for place, s in enumerate(order):
        queue = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0, int.from_bytes(xxhash.xxh64((r[1] or "").encode(), seed=42).digest(), "big", signed=True)))
        clock = 0
        for k, (i, t, _) in enumerate(queue * 2):
            words = (t or "").encode().split()
            clock += len(words)
            if words:
                served.append((clock / target[s], place, k // len(queue), clock, i, t, s, words))
    left, out = int(1.5 * sum(sizes.values())), []
    for *_, i, t, s, words in sorted(served, key=lambda c: c[:4]):
        kept = words[:left]
        left -= len(kept)
        if kept:
            out.append((i, t if len(kept) == len(words) else b" ".join(kept).decode(), s))
    return out


def test_stages(spark, docs, rows, tmp_path):
    """Without labels nothing is toxic; the rest is the composition of the brute-force stages."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = brute_exact(rows)
    component = brute_near([(i, t) for i, t, _ in kept], 5)
    from tests.llm.test_dedup import shingles

    kept = [(i, t, s) for i, t, s in kept if component[last(i), shingles(t, 5)] == last(i)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    want = []
    for i, t, _ in brute_mix(kept):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stage_columns_and_empty(spark, docs, none, tmp_path):
    """Every stage but the last keeps the columns, those with the operators' own names too; empty tables stay empty."""
    spark.createDataFrame([(1, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        assert out.count() > 0
        assert stage(spark, none, str(tmp_path)).count() == 0
