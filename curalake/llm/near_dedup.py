"""MinHash near-duplicate groups by an inverted join on signature coordinates.

* A document's set is its distinct k-word shingles, as 64-bit hashes; equal sets form one class at once.
* Each class has a signature of 64 minima. Two sets of Jaccard similarity 0.8 agree in 51 of them on
  average; in fewer than MATCHES with a probability of about 1e-6.
* Prefix merging: a class is posted under its coordinate-value pairs in the order of rarity. A pair that no
  other class has agrees with nothing, so a class with fewer than MATCHES shared pairs is left out, and of
  n shared pairs the n - MATCHES + 1 rarest are enough: of two classes that agree in MATCHES pairs, one is
  posted for both.
* Skip merging: members of a list that are linked already are skipped, and lists of one component are done.
  First each list compares its members with its central one, whose coordinate-value pairs are the most frequent;
  then with the central one of those that this left outside.
* In what is left of a list, the members outside its largest component meet all others in blocks of bounded size.
  There the collisions of two signatures are counted, and a pair comes out once, at the first list that both are
  posted in, if it has MATCHES of them and passes an exact bound: the shingles of a set are counted by BUCKETS of
  their hash, and two sets can't share more in a bucket than the smaller count.
* Candidates are confirmed on full sets; links give connected components.

A list is never gathered in one task: pivots are maxima with partial aggregation, and the blocks of a list are
keys of their own. A list of n near copies takes about n comparisons with its pivot, and the blocks look at the
signatures of (members outside the largest component) x (members).

Defined results: null texts and texts without words have no shingles and are linked with nothing; a text of
fewer than k words is one shingle, however long; very long texts are hashed whole; equal sets are one class;
rows with one id and different texts are separate; a null id comes last; an empty table gives no rows.
Other columns are not read, so their names may clash with any here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import LAST_ID, LOWER, PLAIN, bit_filter, components, discard, filter_bit, give_back, id_key, saved, spare, text_bytes

COORDINATES = 64
MATCHES = 36
#: Comparisons of a list with central members before its blocks are compared.
PIVOTS = 2
#: Members of a list that meet in one block, about.
BLOCK = 1024
#: Buckets of the counts of a set's shingles.
BUCKETS = 256

_random = np.random.Generator(np.random.PCG64(20240229))
_MUL = _random.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, COORDINATES, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < k:
        h = np.concatenate([h, np.arange(n, k, dtype=np.uint64)])
        n = k
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = out * _BASE + h[i : n - k + 1 + i]
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of 64 hash functions over a set that isn't empty."""
    low = None
    for at in range(0, len(shingles), 512):
        part = ((shingles[at : at + 512, None] * _MUL + _ADD) >> np.uint64(32)).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low.astype(np.uint32)


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_key(id_col).alias("id"), text_bytes(text_col).alias("text"))


def _signed(keyed: DataFrame, k: int) -> DataFrame:
    """id, n_shingles, digest of the set (null if empty) and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, signs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                signs.append(signature(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.list_(pa.int32()))], ["id", "n_shingles", "digest", "sign"])
        give_back()

    return saved(keyed.mapInArrow(run, "id long, n_shingles long, digest binary, sign array<int>"), "signed", **PLAIN)


def bucket_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles of a set each bucket has; 255 stands for more too."""
    return np.minimum(np.bincount(shingles & np.uint64(BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8)


def _sets(keyed: DataFrame, signed: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """digest, signature, set, its size and bucket counts of the classes, from the texts again."""
    wanted = signed.join(classes, "digest", "left_semi")
    bits = bit_filter(wanted.select(filter_bit("id").alias("bit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            digests, sets, counts = [], [], []
            for bit, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held[bit >> 3] >> (bit & 7) & 1:
                    s = shingle_set(text.as_py(), k)
                    if len(s):
                        digests.append(_digest(s))
                        sets.append(s.view(np.int64))
                        counts.append(bucket_counts(s).tobytes())
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(counts, pa.binary())], ["digest", "shingles", "counts"])
        give_back()

    sets = keyed.select(filter_bit("id").alias("bit"), "text").mapInArrow(run, "digest binary, shingles array<long>, counts binary")
    sets = sets.groupBy("digest").agg(F.first(F.struct("shingles", "counts")).alias("s")).select("digest", "s.shingles", "s.counts", F.size("s.shingles").alias("size"))
    return saved(sets.join(wanted.groupBy("digest").agg(F.first("sign").alias("sign")), "digest"), "sets", **PLAIN)


def _postings(signed: DataFrame) -> DataFrame:
    """pos, value, digest, score, posted: the prefix of each class that can have a partner.

    score is larger for a class whose pairs are frequent, posted has the bit of each coordinate in the prefix.
    """
    classes = signed.where("digest is not null").groupBy("digest").agg(F.first("sign").alias("sign"))
    pairs = saved(classes, "classes", **PLAIN).select("digest", F.posexplode("sign").alias("pos", "value"))
    shared = pairs.groupBy("pos", "value").agg(F.count("*").alias("n")).where("n > 1")
    held = pairs.join(shared, ["pos", "value"]).groupBy("digest").agg(F.collect_list(F.struct("n", "pos", "value")).alias("held"), F.sum(F.log("n")).alias("score"))
    prefix = F.slice(F.sort_array("held"), F.lit(1), F.size("held") - (MATCHES - 1))
    rows = held.where(F.size("held") >= MATCHES).select("digest", "score", prefix.alias("prefix"))
    posted = F.aggregate("prefix", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["pos"])))
    return saved(rows.select("digest", "score", posted.alias("posted"), F.explode("prefix").alias("p")).select("p.pos", "p.value", "digest", "score", "posted"), "postings", **PLAIN)


def _bounded(sign_a, sign_b, counts_a, counts_b, size_a, size_b, percent: int) -> np.ndarray:
    """Which rows of pairs have MATCHES collisions and can be as similar as asked."""
    agree = (sign_a == sign_b).sum(1) >= MATCHES
    most = np.minimum(counts_a, counts_b).sum(1, dtype=np.int64) + np.minimum(size_a - counts_a.sum(1, dtype=np.int64), size_b - counts_b.sum(1, dtype=np.int64))
    return agree & (100 * most >= percent * (size_a + size_b - most))


def _arrays(batch: pa.RecordBatch, suffix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, bucket counts and sizes of a batch of profiles."""
    counts = np.frombuffer(b"".join(batch.column("counts" + suffix).to_pylist()), np.uint8).reshape(-1, BUCKETS)
    return batch.column("sign" + suffix).flatten().to_numpy().reshape(-1, COORDINATES), counts, batch.column("size" + suffix).to_numpy().astype(np.int64)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with a column linked. Full sets are joined only to pairs that the signatures and the bound let through."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (sign_a, counts_a, size_a), (sign_b, counts_b, size_b) = _arrays(batch, "_a"), _arrays(batch, "_b")
                keep = _bounded(sign_a, sign_b, counts_a, counts_b, size_a, size_b, percent)
                yield batch.select(["a", "b"]).append_column("possible", pa.array(keep))

    profile = lambda x: sets.select(F.col("digest").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("sign", "counts", "size")))
    checked = saved(pairs.join(profile("a"), "a").join(profile("b"), "b").mapInArrow(possible, "a binary, b binary, possible boolean"), "checked", **PLAIN)
    common = F.size(F.array_intersect("set_a", "set_b"))
    similar = 100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)
    full = lambda x: sets.select(F.col("digest").alias(x), F.col("shingles").alias(f"set_{x}"))
    links = checked.where("possible").join(full("a"), "a").join(full("b"), "b").select("a", "b", similar.alias("linked"))
    return links.unionByName(checked.where("not possible").select("a", "b", F.lit(False).alias("linked")))


def _central(marked: DataFrame) -> DataFrame:
    """pos, value, other, other_label: the central member of each list of marked."""
    best = F.max_by(F.struct("digest", "label"), F.struct("score", "digest")).alias("best")
    return marked.groupBy("pos", "value").agg(best).select("pos", "value", F.col("best.digest").alias("other"), F.col("best.label").alias("other_label"))


_PAIRS = "a binary, b binary"


def _compare(percent: int):
    """Pairs that can be linked, from blocks sorted by key: rows on side 0 meet all others."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        pos = rows.column("pos")[0].as_py()
        side = rows.column("side").to_numpy()
        sign, counts, size = _arrays(rows)
        digest = np.frombuffer(b"".join(rows.column("digest").to_pylist()), ">u8").reshape(-1, 2)
        label = np.unique(np.frombuffer(b"".join(rows.column("label").to_pylist()), ">u8").reshape(-1, 2), axis=0, return_inverse=True)[1].ravel()
        posted = rows.column("posted").to_numpy().view(np.uint64)
        outside = rows.column("outside").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        lower = np.uint64((1 << pos) - 1)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 256):
            x = left[at : at + 256]
            agree = np.zeros((len(x), len(right)), np.uint8)
            for c in range(COORDINATES):
                agree += sign[x, c][:, None] == sign[right, c]
            i, j = np.nonzero((agree >= MATCHES) & (label[x][:, None] != label[right]))
            i, j = x[i], right[j]
            # Two members outside the largest component meet twice.
            both = outside[j]
            first = (digest[i, 0] < digest[j, 0]) | ((digest[i, 0] == digest[j, 0]) & (digest[i, 1] < digest[j, 1]))
            i, j = i[~both | first], j[~both | first]
            near = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
            i, j = i[near], j[near]
            # Of the lists that both are posted in, only the first gives the pair.
            earlier = posted[i] & posted[j] & lower
            again = np.zeros(len(i), bool)
            for c in range(pos):
                again |= (earlier >> np.uint64(c) & np.uint64(1)).astype(bool) & (sign[i, c] == sign[j, c])
            i, j = i[~again], j[~again]
            for b in range(0, len(i), 8192):
                p, q = i[b : b + 8192], j[b : b + 8192]
                good = _bounded(sign[p], sign[q], counts[p], counts[q], size[p], size[q], percent)
                out.append((p[good], q[good]))
        if not any(len(p) for p, _ in out):
            return None
        i, j = map(np.concatenate, zip(*out))
        return pa.RecordBatch.from_arrays([rows.column("digest").take(pa.array(i)), rows.column("digest").take(pa.array(j))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def block() -> Iterator[pa.RecordBatch]:
            if held:
                pairs = found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                if pairs is not None:
                    yield pairs

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("pos", "value", "row", "col")])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for start, stop in zip(starts, np.r_[starts[1:], len(keys)]):
                if tuple(keys[start]) != key:
                    yield from block()
                    held, key = [], tuple(keys[start])
                held.append(batch.slice(start, stop - start))
        yield from block()
        held.clear()
        give_back()

    return run


def _left(marked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar, from the blocks of all lists."""
    by_label = marked.groupBy("pos", "value", "label").agg(F.count("*").alias("n"))
    lists = by_label.groupBy("pos", "value").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("n_outside"))
    lists = saved(lists.where("n_outside > 0").withColumns({"rows": F.ceil(F.col("n_outside") / BLOCK).cast("int"), "cols": F.ceil(F.col("all") / BLOCK).cast("int")}).drop("all", "n_outside"), "lists", **PLAIN)
    members = marked.join(lists, ["pos", "value"]).withColumn("outside", F.col("label") != F.col("main"))
    h = F.xxhash64("digest")
    row, col = F.pmod(h, F.col("rows")).cast("int"), F.pmod(F.shiftright(h, 20), F.col("cols")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ("pos", "value", "digest", "label", "posted", "outside")
    left = members.where("outside").select(*own, F.lit(0).alias("side"), row.alias("row"), upto("cols").alias("col"))
    right = members.select(*own, F.lit(1).alias("side"), upto("rows").alias("row"), col.alias("col"))
    blocks = left.unionByName(right).join(sets.select("digest", "sign", "counts", "size"), "digest")
    key = ("pos", "value", "row", "col")
    return blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(percent), _PAIRS)


def near_duplicate_links(signed: DataFrame, keyed: DataFrame, k: int, percent: int) -> DataFrame | None:
    """The component (node, label) of every class that can have a partner; None if no class can."""
    postings = _postings(signed)
    if postings.isEmpty():
        return None
    classes = postings.select("digest").distinct()
    sets = _sets(keyed, signed, classes, k)
    labels = saved(classes.select(F.col("digest").alias("node"), F.col("digest").alias("label")), "labels", **PLAIN)
    done = None
    for turn in range(PIVOTS + 1):
        marked = postings.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        if turn:
            live = marked.groupBy("pos", "value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("pos", "value")
            marked = marked.join(live, ["pos", "value"], "left_semi")
        marked = saved(marked, "marked", **PLAIN)
        if marked.isEmpty():
            break
        if turn < PIVOTS:
            outside = marked
            for _ in range(turn):
                outside = outside.join(_central(outside), ["pos", "value"]).where("label <> other_label").drop("other", "other_label")
            pairs = marked.join(_central(outside), ["pos", "value"]).where("label <> other_label").select(F.least("digest", "other").alias("a"), F.greatest("digest", "other").alias("b")).distinct()
        else:
            pairs = _left(marked, sets, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        found = saved(_confirmed(pairs, sets, percent), "compared", **PLAIN)
        done = found if done is None else done.unionByName(found)
        discard(marked)
        if not found.where("linked").isEmpty():
            discard(labels)
            labels = components(done.where("linked"))
    return labels.select("node", "label")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    null = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    out = _grouped(docs, k, percent, id_col, text_col)
    return out.select(null("id").alias("doc_id"), "n_shingles", null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    signed = _signed(keyed, k)
    labels = near_duplicate_links(signed, keyed, k, percent)
    rows = signed.select("id", "n_shingles", "digest")
    if labels is None:
        rows = rows.withColumn("label", F.col("digest"))
    else:
        rows = rows.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    rows = saved(rows.drop("digest"), "labelled", **PLAIN)
    least = rows.where("label is not null").groupBy("label").agg(F.min("id").alias("component"))
    return rows.join(least, "label", "left").withColumn("component", F.coalesce("component", "id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which none with a smaller id is a near duplicate, with all their columns. Of rows with one id and one set of shingles, one stays."""
    own = spare(docs, "own_id")
    out = _grouped(docs, k, percent, id_col, text_col)
    fate = saved(out.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.col("component")).alias("n_kept")).where("n > 1 or n_kept = 0"), "fate", **PLAIN)
    keyed = docs.withColumn(own, id_key(id_col))
    left = keyed.join(fate.where("n_kept = 0").select(F.col("id").alias(own)), own, "left_anti")
    mixed = fate.where("n_kept > 0").select(F.col("id").alias(own))
    if mixed.isEmpty():
        return left.select(*docs.columns)
    repeated = left.join(mixed, own, "left_semi")
    return left.join(mixed, own, "left_anti").select(*docs.columns).unionByName(repeated.dropDuplicates([own, text_col]).select(*docs.columns))
