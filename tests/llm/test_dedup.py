"""Exact, near and passage deduplication against brute force."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curalake.llm import near_dedup, substring_dedup
from curalake.llm.exact_dedup import DigestIndex, drop_exact_duplicates, exact_duplicates, normalise

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SPACE = r"[\x20\x09-\x0D]+"
BIG = 1 << 63


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1cab é"))
@settings(max_examples=300, deadline=None)
def test_normalise(text):
    assert normalise(text.encode()) == re.sub(SPACE, " ", text).encode()


@pytest.mark.parametrize("chars", [64, 1])
def test_exact(docs, rows, chars):
    """With one hexadecimal digit nearly all digests collide; the bytes must tell texts apart."""
    norm = [(i, re.sub(SPACE, " ", t or "")) for i, t, _ in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = {t: min(g, key=lambda x: BIG if x is None else x) for t, g in groups.items()}
    want = Counter((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    got = exact_duplicates(docs, digest_chars=chars).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_find(docs):
    """Single texts are looked up in the compacted level."""
    index = DigestIndex(docs.sparkSession)
    index.append(docs)
    assert index.find(index.compact(), ["one", "The cat  sat on the mat and then it went home again today", "not there"]) == {"one": 6, "The cat  sat on the mat and then it went home again today": 1}


def test_exact_drop(docs, rows, none):
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    texts = Counter(re.sub(SPACE, " ", r.text or "") for r in out.collect())
    assert texts == Counter({re.sub(SPACE, " ", t or ""): 1 for _, t, _ in rows})
    assert exact_duplicates(none).count() == 0
    assert drop_exact_duplicates(none).count() == 0


def shingles(text, k):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_near(rows, k):
    """component of each distinct (id, set), ids with None last."""
    nodes = sorted({(BIG if i is None else i, shingles(t, k)) for i, t in rows}, key=lambda x: (x[0], sorted(x[1])))
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(nodes)):
        for y in range(x):
            a, b = nodes[x][1], nodes[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    return {n: nodes[find(x)][0] if n[1] else n[0] for x, n in enumerate(nodes)}


def test_near(spark, docs, rows, none):
    base = [f"x{i}" for i in range(120)]
    more = []
    for n in range(40):  # a chain: each is near the one before, the ends are not near
        w = list(base)
        for j in range(n):
            w[(j * 3) % 120] = f"y{j}"
        more.append((1000 + n, " ".join(w)))
    more += [(2000 + n, " ".join([*base[:60], *(f"z{n}_{j}" for j in range(60))])) for n in range(20)]  # one passage, nothing else
    plain = [(i, t) for i, t, _ in rows] + more
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for k in (4, 5):
        want = brute_near(plain, k)
        got = near_dedup.near_duplicates(df, k=k).collect()
        assert len(got) == len(plain)
        back = lambda x: None if x == BIG else x
        expected = Counter((i, len(shingles(t, k)), back(want[BIG if i is None else i, shingles(t, k)])) for i, t in plain)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(none).count() == 0


def _near_copies(seed=7):
    """A group of copies with words replaced at random, few to many, so that some are linked through others and half aren't linked at all."""
    rng = random.Random(seed)
    base = [f"x{i}" for i in range(150)]
    out = []
    for n in range(90):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 14)):
            w[at] = f"y{rng.randrange(5)}"
        out.append((3000 + n, " ".join(w)))
    return out


@pytest.mark.parametrize("pivots,block", [(2, 1024), (1, 7), (0, 16)])
def test_near_blocks(spark, monkeypatch, pivots, block):
    """However many central members are compared first and however small the blocks are, the components are those of all pairs."""
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = _near_copies()
    want = brute_near(rows, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for (i, _), c in want.items()}


def test_bucket_bound():
    """The bound of the bucket counts is never below the true intersection, not even where counts stop at 255."""
    rng = np.random.default_rng(3)
    for n in (3, 200, 5000, 150_000):
        pool = rng.integers(0, 1 << 62, n, np.uint64)
        a, b = (np.unique(pool[rng.random(n) < 0.9]) for _ in range(2))
        counts = [near_dedup.bucket_counts(x)[None] for x in (a, b)]
        one = np.zeros((1, near_dedup.COORDINATES), np.int32)
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        percent = 100 * common / union
        assert near_dedup._bounded(one, one, *counts, np.array([len(a)]), np.array([len(b)]), percent - 1e-9)[0]
    far = [near_dedup.bucket_counts(np.arange(x, x + 100, dtype=np.uint64) * np.uint64(near_dedup.BUCKETS) + np.uint64(x % 7))[None] for x in (0, 1000)]
    assert not near_dedup._bounded(one, one, *far, np.array([100]), np.array([100]), 80)[0]


def test_near_recall(spark):
    """All pairs of a whole table, by counting common shingles: no link is lost and none is made."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {i: shingles(t, 4) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for h in holders.values():
        common.update(itertools.combinations(sorted(h), 2))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    got = near_dedup.near_duplicates(docs, k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_near_drop(docs, rows, none):
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    # 2 is 1 with other white space; 8, 9 and the null id are 7 but for a few words.
    want = {(i, t) for i, t, _ in rows if i not in (2, 8, 9, None)}
    assert set(kept) == want and set(kept.values()) == {1}
    assert near_dedup.drop_near_duplicates(none).count() == 0


def brute_passages(rows, n):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            first[key] = min(first.get(key, BIG), BIG if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (BIG if i is None else i):
                gone[p : p + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length,hot", [(50, 2000), (50, 1), (5, 2000), (20, 0), (20, 3)])
def test_passages(docs, rows, none, length, hot):
    got = substring_dedup.remove_repeats(docs, length=length, hot=hot).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages([(i, t) for i, t, _ in rows], length)
    assert substring_dedup.remove_repeats(none).count() == 0


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=15), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_automaton(texts, query, least):
    automaton = substring_dedup.SuffixAutomaton()
    held = set()
    for t in texts:
        automaton.add(t)
        held |= {tuple(t[i : i + least]) for i in range(len(t) - least + 1)}
    want = {j for i in range(len(query) - least + 1) if tuple(query[i : i + least]) in held for j in range(i, i + least)}
    assert {j for s, e in automaton.matches(query, least) for j in range(s, e)} == want
