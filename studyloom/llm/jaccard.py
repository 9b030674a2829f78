"""N-gram Jaccard join: all documents whose shingle sets are similar, by partitioning the universe.

Sets of at least one shingle go into bands by size, so that similar sets are in one
band or in neighbouring ones. In a band, J >= t leaves at most H different shingles. The
universe of shingles is cut into m segments by hash:

* m = H + 1 + e segments of which H can differ, so 1 + e are equal, and a set may leave
  out e. It leaves out its empty ones (with more than e of them, none), and then those
  whose signatures cost most: the commonest over all sets, counted once they are known.
  Of the equal segments of two similar sets the rarest is left out by neither.
* Where sets are small, segments would be too, and (H + 1) / 2 segments with their
  one-deletion neighbourhoods cost less: H differences leave one segment with at most
  one, so a segment or its one-deletions meet.

Which of the two a band has is decided by its sizes. Signatures that two different sets
share make candidates.

Equal sets are one class from the start. A task sends a signature on once, whatever the
number of its sets that share it; members that met inside a task are known to share it.
Candidates are settled in rounds, all exact: each member against its signature's smallest
member first; where a signature's members are not yet in one component, those outside its
largest one against a member of that, a few times, with another member each; and what is
still apart by all pairs from different components, in blocks, for all signatures of one smallest member together. Sketches (a byte for each of many finer
segments) give a lower bound of the difference that dismisses most pairs; the others
are verified on whole sets, which come together once for all pairs of a block.

Documents without words have no set and no links. Rows without an id are skipped; rows
that repeat an id are one document, with the smallest of their texts. Other columns are
ignored; an empty table stays so. A very long text is one set, held by one task at a time.
Shingles are 64-bit hashes; sets are compared on 48 bits of them: of two unequal shingles
of a pair of sets with 10,000 each, two agree by chance once in 2.8 million pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.llm._store import first_texts, keep, keep_bucketed, rows_of
from studyloom.llm._text import NOT_SPACE, Words, chain, mix, slices, spread, text_bytes
from studyloom.llm.components import components

SMALL_SET = 64
#: Of so many segments that may differ, one more is added that a set may leave out.
LEAVE_OUT = 8
FLUSH_ENTRIES = 600_000
BUCKET_ENTRIES = 1_000_000
BLOCK_ROWS = 1024
#: Rounds of stars around other members before all pairs are compared; they change no result, only its cost.
STAR_ROUNDS = 3
#: Sets that come together to be verified: bytes and number of each of the two blocks.
VERIFY_BYTES, VERIFY_ROWS = 1 << 20, 256
SKETCH = 256


class Bands:
    """Size bands and their segments for a similarity of ``percent`` / 100."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 10_000 // percent**2)))
        high = np.array(self.low[1:]) - 1
        differ = self.most_different(2 * high)
        self.deletes = (high < SMALL_SET) & (differ > 0)
        self.spare = np.zeros(len(high), np.int64)
        self.segments = np.where(self.deletes, (differ + 2) // 2, differ + 1)
        for b in np.flatnonzero(~self.deletes & (differ > 0)):
            for _ in range(4):  # more segments, more empty ones
                empty = self.segments[b] * exp(-self.low[b] / self.segments[b])
                self.spare[b] = ceil(empty + 3 * sqrt(empty)) + differ[b] // LEAVE_OUT
                self.segments[b] = differ[b] + 1 + self.spare[b]
        self.low = np.array(self.low)

    def most_different(self, sizes: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of two similar sets with these sizes together."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def signatures(self, sets: Sets, above: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signature, set number, and how many more signatures the set may leave out, of all sets in their own band, or of those that reach into the next one above."""
        n = sets.n
        band = self.of(n) + above
        which = np.flatnonzero((n > 0) & (band < len(self.segments)))
        if above:
            which = which[n[which] * 100 >= self.percent * self.low[band[which]]]
        band = band[which]
        m = self.segments[band]
        base = np.concatenate([[0], np.cumsum(m)])
        at = spread(sets.at[which], n[which])
        u = sets.elements[at]
        own = np.repeat(np.arange(len(which)), n[which])
        slot = base[own] + (mix(u + np.uint64(11)) % m[own].astype(np.uint64)).astype(np.int64)
        content = mix(u)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, content)
        filled = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(which)), m)
        place = mix(((band[owner].astype(np.uint64) << np.uint64(40)) | (np.arange(base[-1]) - base[owner]).astype(np.uint64)) + np.uint64(1))
        empty = np.bincount(owner, filled == 0, len(which))
        on = (filled > 0) | (self.deletes[band] | (empty > self.spare[band]))[owner]
        less = np.flatnonzero(self.deletes[band][own])
        signature = [chain(total[on], place[on]), chain(total[slot[less]] - content[less], place[slot[less]])]
        left = np.where(empty > self.spare[band], 0, self.spare[band] - empty).astype(np.int64)
        by = np.concatenate([owner[on], own[less]])
        return np.concatenate(signature), which[by], left[by]


class Sets:
    """The shingle sets of a batch: distinct hashes text by text, sizes, and two 64-bit hashes of each set."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        h, at = Words(data, offsets, NOT_SPACE).shingles(k)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.elements, text = h[new], text[new]
        self.n = np.bincount(text, minlength=len(at) - 1)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.hashes = []
        for salt in (3, 5):
            total = np.zeros(len(self.n), np.uint64)
            np.add.at(total, text, mix(self.elements ^ np.uint64(salt << 50)))
            self.hashes.append(total)

    def sketch(self, i: int, size: int) -> bytes:
        """A byte for each of ``size`` segments: the sum of its shingles' bytes, so that halves add up to the sketch of half the size."""
        u = self.elements[self.at[i] : self.at[i + 1]]
        total = np.zeros(size, np.uint8)
        np.add.at(total, (mix(u + np.uint64(23)) % np.uint64(size)).astype(np.int64), (mix(u) >> np.uint64(56)).astype(np.uint8))
        return total.tobytes()


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) at a smaller size, a power of two."""
    return sketches.reshape(len(sketches), -1, size).sum(1, dtype=np.uint8)


def sketch_size(n: int, percent: int) -> int:
    """A power of two that is twice the allowed difference of sets in the same or a neighbouring band, or more."""
    differ = 2 * n * (100 - percent) // (100 + percent)
    return max(SKETCH, 1 << min(12, max(0, 2 * differ - 1).bit_length()))


def _batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for whole in batches:
        for batch in slices(whole, "text"):
            yield batch, Sets(*text_bytes(batch.column("text")), k)


def set_sizes(docs: DataFrame, k: int) -> DataFrame:
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _batches(batches, k):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets.n, pa.int64()), *[pa.array(h.view(np.int64)) for h in sets.hashes]], ["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(sizes, "doc_id long, n long, s1 long, s2 long")


def _six(elements: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, sorted."""
    return np.sort(elements >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def shared_signatures(docs: DataFrame, k: int, percent: int, largest: int, shingles: int) -> DataFrame:
    """signature, doc_id, above, left: members of signatures that two or more different sets have.

    above: whether of the band above the set's own; left: how many of its signatures there the set may leave out.
    """
    bands = Bands(percent, largest)
    buckets = max(1, -(-int(shingles * 3 * (100 - percent) / (100 + percent) * 2) // BUCKET_ENTRIES))

    def emit(sig: np.ndarray, doc: np.ndarray, set_of: np.ndarray, above: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One entry per signature to its bucket; all members of those with several, as they are."""
        order = np.lexsort((doc, sig))
        sig, doc, set_of, above, left = (x[order] for x in (sig, doc, set_of, above, left))
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        several = ~first
        several[:-1] |= ~first[1:]
        all_of = lambda p: (sig[p], doc[p], doc[p], above[p], left[p])
        rows = [(-1 - (int(doc[p[0]]) + k) % buckets, *all_of(p)) for k, p in enumerate(np.array_split(np.flatnonzero(several), max(1, np.count_nonzero(several) // 100_000))) if len(p)]
        sig, doc, set_of, above, left = (x[first] for x in (sig, doc, set_of, above, left))
        cuts = np.searchsorted(sig, (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets)[1:-1].astype(np.uint64)) if buckets > 1 else np.empty(0, np.int64)
        rows += [(b, *part) for b, part in enumerate(zip(*[np.split(x, cuts) for x in (sig, doc, set_of, above, left)], strict=True)) if len(part[0])]
        packed = []
        for b, s, d, h, up, le in rows:
            known, number = np.unique(d, return_inverse=True)
            hashes, may = np.zeros(len(known), np.uint64), np.zeros(2 * len(known), np.uint16)
            hashes[number] = h.view(np.uint64)
            number = 2 * number + up
            may[number] = le
            small = np.uint16 if len(may) <= 1 << 16 else np.uint32
            packed.append((b, s.tobytes(), number.astype(small).tobytes(), known.tobytes(), hashes.tobytes(), may.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int64()), *[pa.array([p[i] for p in packed], pa.binary()) for i in range(1, 6)]], ["bucket", "sig", "number", "known", "hashes", "left"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch, sets in _batches(batches, k):
            doc = batch.column("doc_id").to_numpy()
            for above in (False, True):
                sig, own, left = bands.signatures(sets, above)
                held.append((sig, doc[own], sets.hashes[0][own], np.full(len(sig), above, np.int64), np.minimum(left, 65535)))
            if sum(len(x[0]) for x in held) > FLUSH_ENTRIES:
                yield from emit(*once(held))
                held = []
        if held:
            yield from emit(*once(held))

    def once(held: list) -> tuple[np.ndarray, ...]:
        """All entries, each set by its smallest document only."""
        sig, doc, set_of, above, left = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, set_of))
        first = np.ones(len(order), bool)
        first[1:] = set_of[order][1:] != set_of[order][:-1]
        least = np.repeat(doc[order][first], np.diff(np.append(np.flatnonzero(first), len(order))))
        on = np.empty(len(order), bool)
        on[order] = doc[order] == least
        return sig[on], doc[on], set_of[on], above[on], left[on]

    def meet(table: pa.Table) -> pa.Table:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        for s, number, known, hashes, may in zip(*[table.column(c).to_pylist() for c in ("sig", "number", "known", "hashes", "left")], strict=True):
            s = np.frombuffer(s, np.uint64)
            number = np.frombuffer(number, np.uint16 if len(number) == 2 * len(s) else np.uint32)
            for x, v in zip(held, (s, np.frombuffer(known, np.int64)[number // 2], np.frombuffer(hashes, np.uint64)[number // 2], (number % 2).astype(np.int8), np.frombuffer(may, np.uint16)[number]), strict=True):
                x.append(v)
        sig, doc, set_of, above, left = map(np.concatenate, held)
        if table.column("bucket")[0].as_py() >= 0:
            order = np.lexsort((doc, set_of, sig))
            sig, doc, set_of, above, left = (x[order] for x in (sig, doc, set_of, above, left))
            first = np.ones(len(sig), bool)
            first[1:] = (sig[1:] != sig[:-1]) | (set_of[1:] != set_of[:-1])
            sig, doc, above, left = sig[first], doc[first], above[first], left[first]
            same = sig[1:] == sig[:-1]
            on = np.zeros(len(sig), bool)
            on[1:] |= same
            on[:-1] |= same
            sig, doc, above, left = sig[on], doc[on], above[on], left[on]
        return pa.table([pa.array(sig.view(np.int64)), pa.array(doc), pa.array(above, pa.int8()), pa.array(left.astype(np.int32))], names=["signature", "doc_id", "above", "left"])

    blobs = docs.mapInArrow(index, "bucket long, sig binary, number binary, known binary, hashes binary, left binary")
    return blobs.groupBy("bucket").applyInArrow(meet, "signature long, doc_id long, above byte, left int")


def rarest(members: DataFrame) -> DataFrame:
    """signature, doc_id: members without each set's commonest signatures, as many as it may leave out."""
    sizes = keep(members.groupBy("signature").agg(F.count("*").alias("size")).where("size > 1"))
    order = Window.partitionBy("doc_id", "above").orderBy(F.desc("size"), "signature")
    return members.join(sizes, "signature").withColumn("rank", F.row_number().over(order)).where(F.col("rank") > F.col("left")).select("signature", "doc_id")


def set_table(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, sketch, words (6 bytes a shingle)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _batches(batches, k):
            sketches = [sets.sketch(i, sketch_size(int(n), percent)) for i, n in enumerate(sets.n)]
            words = [_six(sets.elements[a:b]) for a, b in zip(sets.at[:-1], sets.at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets.n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(words, pa.binary())], ["doc_id", "n", "sketch", "words"])

    return docs.mapInArrow(rows, "doc_id long, n long, sketch binary, words binary")


def _may_link(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and sketches (rows of bytes) allow the similarity."""
    differ = (a != b).sum(-1)
    return (np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent) & (differ * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _with_both(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b) with columns of both sets; the table of sets is in buckets and stays where it is."""
    for side in ("a", "b"):
        mine = sets.select("doc_id", *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.withColumnRenamed(side, "doc_id").join(mine, "doc_id").withColumnRenamed("doc_id", side)
    return pairs


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (key, a, b) that their sketches don't rule out, with the larger set's size."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            at = lambda s, t: folded(np.frombuffer(s, np.uint8)[None], min(len(s), len(t)))[0]
            on = [bool(_may_link(n_a[i], n_b[i], at(s, t), at(t, s), percent)) for i, (s, t) in enumerate(zip(x, y, strict=True))]
            found = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("a"), batch.column("b"), pa.array(np.maximum(n_a, n_b))], ["key", "a", "b", "n"])
            yield found.filter(pa.array(on, pa.bool_()))

    return _with_both(pairs, sets, ["n", "sketch"]).mapInArrow(check, "key long, a long, b long, n long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (key, a, b, n) that are similar, as a, b, by their whole sets.

    Pairs of one key have sets in common. A key's sets are dealt to blocks of bounded size,
    and each two blocks meet in a task, so that a set travels once for all its pairs there.
    """
    pairs = keep(pairs)
    sized = pairs.groupBy("key").agg(F.max("n").alias("n"), (F.approx_count_distinct("a") + F.approx_count_distinct("b")).alias("docs"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / VERIFY_ROWS), F.ceil(F.col("docs") * F.col("n") * 6 / VERIFY_BYTES)).cast("int")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    dealt = pairs.drop("n").join(sized.select("key", blocks.alias("blocks")), "key")
    dealt = keep(dealt.select("key", F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b"))
    ends = dealt.select("key", "i", "j", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    words = ends.join(sets.select("doc_id", "words"), "doc_id").toDF("doc_id", "of_key", "of_i", "of_j", "words")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(ids := right.column("doc_id").to_numpy())
        ids, held = ids[order], right.column("words").combine_chunks()
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        on, last, x = np.zeros(len(a), bool), -1, np.empty(0, np.uint64)
        at = [order[np.searchsorted(ids, c)] for c in (a, b)]
        for p in np.argsort(at[0], kind="stable"):
            if at[0][p] != last:
                last = at[0][p]
                x = _eight(held[int(last)].as_py())
            both = np.concatenate([x, _eight(held[int(at[1][p])].as_py())])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            on[p] = 100 * shared >= percent * (len(both) - shared)
        return pa.table([pa.array(a[on]), pa.array(b[on])], names=["a", "b"])

    return dealt.groupBy("key", "i", "j").cogroup(words.groupBy("of_key", "of_i", "of_j")).applyInArrow(check, "a long, b long")


def other_stars(members: DataFrame, labels: DataFrame, nth: int) -> DataFrame:
    """key, a, b: members outside the largest component of their signature, each with one member of that."""
    labelled = members.join(labels, members.doc_id == labels.node, "left").select("signature", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    parts = labelled.groupBy("signature", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("doc_id", F.lit(nth)), "doc_id")).alias("p"))
    homes = parts.groupBy("signature").agg(F.max(F.struct("n", (-F.col("label")).alias("l"), F.col("p.doc_id").alias("pivot"))).alias("h"), F.count("*").alias("k")).where("k > 1")
    away = labelled.join(homes.select("signature", (-F.col("h.l")).alias("home"), "h.pivot"), "signature").where("label <> home")
    return away.select(F.col("pivot").alias("key"), F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()


def cross_pairs(members: DataFrame, labels: DataFrame, pivots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a signature, are in different components, and may be similar by their sketches."""
    labelled = members.join(labels, members.doc_id == labels.node, "left").select("signature", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    mixed = labelled.groupBy("signature").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("signature", "size")
    # all signatures of one pivot together, so that a set goes on once for them and a pair is told once
    left = labelled.join(mixed.select("signature"), "signature").join(pivots, "signature").groupBy("pivot", "doc_id", "label").agg(F.collect_list("signature").alias("signatures"))
    left = keep(left)
    left = left.join(left.groupBy("pivot").agg(F.count("*").alias("size")), "pivot").join(sets.select("doc_id", "n", "sketch"), "doc_id")
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(table: pa.Table) -> pa.Table:
        doc, n, label, pivot, block = (table.column(c).to_numpy() for c in ("doc_id", "n", "label", "pivot", "own"))
        sketches, a, b = table.column("sketch").to_pylist(), [], []
        sizes = np.array(list(map(len, sketches)))
        held = table.column("signatures").combine_chunks()
        starts, flat = held.offsets.to_numpy(), held.values.to_numpy()
        row = np.repeat(np.arange(len(doc)), np.diff(starts))
        _, number = np.unique(flat, return_inverse=True)
        members = row[np.argsort(number, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(number))])
        names, counts = np.unique(label, return_counts=True)
        home = label == names[np.argmax(counts)]
        two = len(np.unique(block)) > 1
        # of two in different components one is outside the largest
        for x in np.flatnonzero(~home & (doc != pivot)):
            met = np.zeros(len(doc), bool)
            for k in number[starts[x] : starts[x + 1]]:
                met[members[ends[k] : ends[k + 1]]] = True
            met &= (label != label[x]) & (doc != pivot) & (home | (np.arange(len(doc)) > x))
            if two:
                met &= block != block[x]
            met &= np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent
            for z in np.unique(sizes[met]):
                y, size = np.flatnonzero(met & (sizes == z)), min(z, sizes[x])
                s = folded(np.frombuffer(b"".join(sketches[k] for k in y), np.uint8).reshape(-1, z), size)
                y = y[_may_link(n[x], n[y], folded(np.frombuffer(sketches[x], np.uint8)[None], size), s, percent)]
                a.append(np.full(len(y), doc[x]))
                b.append(doc[y])
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
        key = np.full(len(a), pivot[0])
        return pa.table([pa.array(key, pa.int64()), pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(np.full(len(a), n.max()), pa.int64())], names=["key", "a", "b", "n"])

    found = dealt.select("pivot", "i", "j", "own", "doc_id", "n", "label", "signatures", "sketch").groupBy("pivot", "i", "j").applyInArrow(compare, "key long, a long, b long, n long")
    # pivots that share a pair: it stays with the smallest, so that the pairs of similar sets stay together
    return found.groupBy("a", "b").agg(F.min(F.struct("key", "n")).alias("x")).select("x.key", "a", "b", "x.n")


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return _components(_first_texts(docs)[0], k, percent)


def _first_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    return first_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null"))


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """docs: one row a doc_id."""
    sizes = keep(set_sizes(docs, k))
    most = sizes.agg(F.max("n"), F.sum("n")).first()
    # a table of its own, so that the join with it can split a large class
    classes = keep(sizes.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    rep = sizes.join(classes, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    if not most[0]:
        return rep.select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    rep = keep(rep)
    found = shared_signatures(docs, k, percent, most[0], most[1]).join(rep.select("doc_id", "rep"), "doc_id").select("signature", F.col("rep").alias("doc_id"), "above", "left").distinct()
    members = keep(rarest(keep(found)))
    pivots = keep(members.groupBy("signature").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size"))
    stars = members.join(pivots, "signature").where("doc_id <> pivot").select(F.col("pivot").alias("key"), F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    involved = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
    sets = keep_bucketed(set_table(docs.join(involved, "doc_id", "left_semi"), k, percent), "doc_id")
    first = keep(verified(likely(stars, sets, percent), sets, percent))
    labels, links, several = components(first), first, keep(members.join(pivots, "signature", "left_semi"))
    for nth in range(STAR_ROUNDS):
        more = keep(verified(likely(other_stars(several, labels, nth), sets, percent), sets, percent))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = components(links)
    rest = verified(cross_pairs(several, labels, pivots, sets, percent), sets, percent)
    labels = components(links.unionByName(rest))
    return rep.join(labels, rep.rep == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))


def drop_similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Rows without an id stay. Of rows that share an id with different texts the smallest text
    is the document; rows with another text are compared with nothing, and stay.
    """
    one, again = _first_texts(docs)
    copies = _components(one, k, percent).where("doc_id <> component_id").select("doc_id")
    if again is None:
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    gone = copies.join(again.select("doc_id", F.struct("text").alias("its")), "doc_id", "left").alias("gone")
    same = F.col("gone.its").isNull() | F.col("kept.text").eqNullSafe(F.col("gone.its.text"))
    return docs.alias("kept").join(gone, (F.col("kept.doc_id") == F.col("gone.doc_id")) & same, "left_anti")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(rows_of(spark, sf_dir, "documents"), 3, 90)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS c FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
QUERIES: dict[str, Callable] = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLES = {"op3_ngram_jaccard": SQL}
