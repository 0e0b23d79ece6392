"""Tokenizers, token files and mixing."""

import hashlib
import time
import zlib
from array import array
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from curalake.llm import bpe, mixing, queries, token_files  # noqa: E402
from curalake.llm.mixing import fair_counts, mix  # noqa: E402
from tests.llm.test_pipeline import brute_mix  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ANY = st.one_of(st.text(max_size=40), st.text(alphabet="aab tThe'sdll.,!? \n\t\x1cÅΣé½1 ", max_size=40))


@pytest.fixture(scope="module")
def word_library():
    t = Tokenizer.from_file(WORDS)
    t.no_padding()
    t.no_truncation()
    return t


@given(ANY)
@settings(max_examples=500, deadline=None)
def test_automaton_is_the_library(word_library, text):
    own = bpe.tokenizer(WORDS)
    ids = word_library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == word_library.decode(ids, skip_special_tokens=False)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12, unique=True), st.text(alphabet="abc", min_size=1, max_size=14))
@settings(max_examples=500, deadline=None)
def test_gadgets_accept_what_merging_gives(pairs, text):
    """For random merges over three letters the automaton accepts exactly the pairs of neighbours that merging leaves."""
    texts = ["a", "b", "c"]
    merges = []
    for a, b in pairs:
        a, b = a % len(texts), b % len(texts)
        if texts[a] + texts[b] not in texts:
            merges.append((a, b, len(texts)))
            texts.append(texts[a] + texts[b])
    auto = bpe.MergeAutomaton([0, 1, 2], merges)
    ids = [texts.index(c) for c in text]
    for a, b, c in merges:
        out = []
        for x in ids:
            if out and out[-1] == a and x == b:
                out[-1] = c
            else:
                out.append(x)
        ids = out
    assert all(auto.arc(a, b) for a, b in zip(ids, ids[1:])) and all(map(auto.reached, ids))

    def paths(rest, last):
        if not rest:
            yield []
        for t, s in enumerate(texts):
            if rest.startswith(s) and auto.reached(t) and (last is None or auto.arc(last, t)):
                yield from ([t, *p] for p in paths(rest[len(s) :], t))

    assert list(paths(text, None)) == [ids]


def test_long_words(word_library):
    """A word of a million letters takes seconds, and has the tokens of the library."""
    own = bpe.tokenizer(WORDS)
    for letters in ("a", "abcdefg", "x1-"):
        text = (letters * (1_000_000 // len(letters) + 1))[:1_000_000]
        began = time.monotonic()
        ids = own.encode(text)
        assert time.monotonic() - began < 10
        assert own.encode(text[:20_000]) == word_library.encode(text[:20_000], add_special_tokens=False).ids
        assert "".join(own.decode(ids).split()).replace("</w>", "") == text


def test_bpe_rows(docs, rows, none, word_library):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = Counter()
    for i, t, _ in rows:
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(word_library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.round_trip_digests(docs, WORDS).collect()) == want
    assert bpe.round_trip_digests(none, WORDS).count() == 0
    texts = bpe.decode(bpe.encode(docs.select("doc_id", "text"), WORDS), WORDS).collect()
    assert Counter(sha(r.decoded) for r in texts) == Counter(k[3] for k in want.elements())


@given(ANY)
@settings(max_examples=500, deadline=None)
def test_pieces_are_the_library(text):
    e = token_files.encoder(BYTES)
    assert array("H", e.ids(text)).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs, rows, none, tmp_path):
    t = Tokenizer.from_file(BYTES)
    shards = token_files.write_token_files(docs, BYTES, 2, str(tmp_path), length=64)
    got = sorted(token_files.read_documents(spark, str(tmp_path), shards).collect(), key=lambda r: r.start)
    ids = [None if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: 1 << 63 if x is None else x) and len(got) == len(rows)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    own = {(i, zlib.crc32(array("I", [*t.encode(x or "", add_special_tokens=False).ids, 2]).tobytes())) for i, x, _ in rows}
    assert {(r.doc_id, r.ids_crc32) for r in got} == own
    shard = token_files.ShardReader(str(tmp_path), shards[0][0])
    sequence, mask = shard.sequence(0)
    assert len(sequence) == 64 and mask[0] and not sequence.flags.owndata
    total = sum(int(shard.sequence(i)[1].sum()) for i in range(sum(shard.file.get_batch(b).num_rows for b in range(shard.file.num_record_batches))))
    assert total == shards[0][2]
    assert isinstance(shard.file.schema.field("ids").type, pa.FixedSizeListType)
    assert token_files.token_files(none, BYTES).count() == 0


def brute_counts(rows):
    """Words that the mix takes of each id, source and size."""
    taken = Counter()
    for i, t, s in brute_mix(rows):
        taken[i, s] += len(t.encode().split())
    return taken


def test_mix(docs, rows, none):
    got = fair_counts(docs).collect()
    sizes, by_source = Counter(), defaultdict(int)
    for i, t, s in rows:
        by_source[s] += len((t or "").encode().split())
        sizes[i, len((t or "").encode().split())] += 1
    assert Counter((r.doc_id, r.size) for r in got) == sizes
    total = sum(by_source.values())
    order = sorted(by_source, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    free, budget = set(order), 1.5 * total
    while free:  # share by weight, stop sources at twice their size, share the excess again
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * by_source[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * by_source[s]
            budget -= target[s]
        free -= full
    source = {(i, len((t or "").encode().split())): s for i, t, s in rows}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.target == pytest.approx(target[s]) and r.source_size == by_source[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert sum(taken.values()) == int(1.5 * total)
    assert all(target[s] - taken[s] <= longest[s] for s in order)
    want = Counter()
    for (_, s), n in brute_counts(rows).items():
        want[s] += n
    assert +want == +taken
    out = mix(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == Counter(brute_mix(rows))
    assert fair_counts(none).count() == 0 and mix(none).count() == 0


def test_mix_of_one_row_in_two_sources(spark):
    """An id and text that two sources share are served for each of them."""
    rows = [(1, "a b c d", "s1"), (1, "a b c d", "s2"), (2, "e f", "s1"), (2, "e f", "s1"), (3, "g h i j k", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sum(r.taken for r in fair_counts(df).collect()) == int(1.5 * sum(len(t.split()) for _, t, _ in rows))
    assert Counter((r.doc_id, r.text, r.source) for r in mix(df).collect()) == Counter(brute_mix(rows))


def test_mix_order(spark):
    """Brute force: copies in the order of finish time, until the budget is spent."""
    rows = [(n, " ".join(f"t{n}_{k}" for k in range(n % 7)), f"s{n % 3}") for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert [(r.doc_id, r.text, r.source) for r in mix(df).collect()] == brute_mix(rows)


def test_fair_queue(spark, docs, none, monkeypatch):
    """op7 takes what the queue over all sources serves, and the cut at the budget removes words of the copies behind it."""
    hot = [(n, " ".join(["w"] * (9000 if n == 177 else n % 13)), "hot" if n % 10 else f"s{n % 7}") for n in range(100, 6000)]
    df = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(hot, "doc_id long, text string, source string"))
    seen, served = [], mixing._served
    monkeypatch.setattr(mixing, "_served", lambda taken: seen.append(served(taken)) or seen[-1])
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = queries.op7_mixing(spark, "").collect()
    taken = Counter()
    every = [tuple(r) for r in df.collect()]
    for r in got:
        taken[r.doc_id] += r.taken
    want = Counter()
    for (i, _), n in brute_counts(every).items():
        want[i] += n
    assert +taken == +want
    queue = sorted((r.finish, r.place, r.copy, r.before, r.served, r.size) for r in seen[0].collect())
    total, budget = 0, sum(taken.values())
    for *_, ahead, size in queue:
        assert ahead == total
        total += size
    assert total == 2 * sum(len((t or "").encode().split()) for _, t, _ in every) > budget
    assert any(ahead < budget < ahead + size for *_, ahead, size in queue)  # a copy is cut at the word
    assert fair_counts(none).count() == 0
