"""Exact substring dedup: bytes covered by a long string that starts in an earlier document as well are removed.

Documents are cut into anchored segments: of the 31 20-byte grams in a 50-byte window
the one with the smallest hash is its anchor, so equal windows have equal anchors, and
windows in a row with one anchor are a segment of at most 80 bytes. Then

1. anchors that two different texts share are found by hash, a task sending each anchor
   on once if several of its documents have it;
2. only segments with shared anchors go to shards, by anchor. Equal segments are settled
   at once: all but the one with the smallest document are covered. Anchors in a large
   share of the documents are dealt out by single windows instead, so none fills a shard;
3. of the different segments of an anchor those that are alike on one side of it too stay;
   the shard builds the Burrows-Wheeler transform of their bytes and expands intervals
   breadth-first, backward, a byte a level. A level sets the common prefixes of its length; after ``length`` levels those
   not set are as long or longer, and mark windows that are equal;
4. spans meet their document again, and what they cover is removed.

Later copies of whole texts (``length`` bytes or more) are covered without any of this.
Strings are judged on the input; null text is empty; rows without an id are skipped. Of
rows that repeat an id the one with the smallest text is the document, and so are equal
ones; others with that id are no source and stay whole. Other columns are ignored. A
text of any length is cut piece by piece; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm._store import first_texts, keep, rows_of
from studyloom.llm._text import chain, mix, slices, spread, text_bytes

LENGTH = 50
GRAM = 20
#: Texts are hashed this many bytes at a time, so that the arrays stay in a core's cache.
PIECE = 1 << 16
FLUSH = 400_000
BUCKET_ENTRIES = 1_000_000
SLICE = 1 << 20
SHARD_BYTES = 4 << 20
#: Segments of a task go on in lots of about this size, so that lots times shards stays far below the number of segments.
LOT_BYTES = 8 << 20
#: Anchors in more than this share of all documents (and HOT_LEAST documents) are dealt by window. A
#: document has a bounded number of anchors per byte, so there are few: their number follows from the share.
HOT_SHARE, HOT_LEAST = 0.005, 4096


def _words(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The 8 bytes from each byte on as a number; data must outlive it."""
    return np.ndarray((max(0, len(data) - 7),), ">u8" if big else "<u8", data, 0, (1,))


_HIGH = ~np.uint64((1 << 24) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on."""
    words = _words(data).copy()  # once: what isn't aligned is slow to read
    n = len(data) - GRAM + 1
    h = words[:n] * _ODD[0]
    for at, odd in ((8, _ODD[1]), (GRAM - 8, _ODD[2])):
        h += words[at : at + n] * odd
    h ^= h >> np.uint64(32)
    h *= _ODD[3]
    return h


class Anchors:
    """Segments of a batch of texts: text, number in the text, first window, windows, and the anchor's hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
        self.data, self.offsets = np.ascontiguousarray(data), offsets
        parts = []
        at = 0
        while at < len(offsets) - 1:  # texts of some MB together, or a long one in overlapping pieces
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            for lo in range(int(offsets[at]), int(offsets[end]), PIECE):
                hi = int(offsets[end]) if offsets[end] - offsets[at] <= PIECE else min(lo + PIECE + length - 1, int(offsets[end]))
                parts.append(self._part(lo, hi, length))
                if hi == offsets[end]:
                    break
            at = end
        self.start, self.n, self.hash, self.text = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(4))
        self.hash = self.hash.astype(np.uint64)
        self.number = np.arange(len(self.start)) - np.searchsorted(self.text, np.arange(len(offsets)))[self.text] if len(self.start) else self.text

    def _part(self, lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        if hi - lo < length:
            return none
        gram = _grams(self.data[lo:hi])
        key = gram & _HIGH
        key |= np.arange(len(gram), dtype=np.uint64)
        span, least = length - GRAM + 1, key
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        windows = hi - lo - length + 1
        least = np.minimum(least[:windows], least[span - width : span - width + windows])
        new = np.ones(windows, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        # windows that cross from text to text are runs of their own, which go
        texts = np.arange(np.searchsorted(self.offsets, lo, "right") - 1, np.searchsorted(self.offsets, hi, "left"))
        edges = self.offsets[texts[1:]] - lo
        new[edges[edges < windows]] = True
        across = edges - length + 1
        new[across[(across >= 0) & (across < windows)]] = True
        first = np.flatnonzero(new)
        n = np.diff(first, append=windows)
        text = texts[np.searchsorted(self.offsets[texts], first + lo, "right") - 1]
        on = np.flatnonzero(first + lo + length <= self.offsets[text + 1])
        first = first[on]
        anchor = gram[(least[first] & ~_HIGH).astype(np.int64)]
        # the smallest of many hashes is small: mixed again, so that buckets are even
        return first + lo, n[on], mix(anchor + np.uint64(7)), text[on]


def span_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of byte spans of 8 bytes or more; words: see _words."""
    out = []
    for seed in (np.uint64(1), np.uint64(1 << 33)):
        h = mix(size.astype(np.uint64) + seed)
        for j in range(0, int(size.max(initial=0)), 8):
            on = np.flatnonzero(size > j)
            h[on] = chain(h[on], words[np.minimum(start[on] + j, start[on] + size[on] - 8)])
        out.append(h)
    return out[0], out[1]


def _bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans' bytes end to end."""
    parts = [data[spread(start[i : i + 8192], size[i : i + 8192])] for i in range(0, len(start), 8192)]  # an index takes eight times the bytes
    return np.concatenate(parts) if parts else data[:0]


class Segments:
    """Different byte strings, each with its smallest document, and where that document has it.

    Of equal strings only the smallest document's stay; ``covered`` holds the others.
    """

    def __init__(self, key: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray):
        """A string's key, place and size in data, its document and its start there, for each occurrence."""
        h = span_hashes(_words(data), at, size)
        order = np.argsort(h[0], kind="stable")
        a, b = h[0][order], h[1][order]
        new = np.append(True, a[1:] != a[:-1]) if len(a) else np.empty(0, bool)
        if len(a) and (b != b[np.flatnonzero(new)][np.cumsum(new) - 1]).any():  # one hash alike, the other not
            order = np.lexsort((h[1], h[0]))
            a, b = h[0][order], h[1][order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        begin = np.flatnonzero(new)
        group, sorted_doc = np.cumsum(new) - 1, doc[order]
        least = np.minimum.reduceat(sorted_doc, begin) if len(begin) else sorted_doc
        same = sorted_doc == least[group]
        stays, gone = order[same], order[~same]
        first = order[begin]  # any of the equal strings
        self.key, self.size = key[first], size[first]
        self.data, self.owner = _bytes(data, at[first], size[first]), least
        self.of, self.doc, self.start = group[same], doc[stays], start[stays]
        self.covered = doc[gone], start[gone], size[gone]


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values from cut to cut, as binaries."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A column of binaries as numbers end to end, and n + 1 offsets."""
    data, offsets = text_bytes(pa.concat_arrays(table.column(column).chunks))
    kind = np.dtype(kind)
    return np.frombuffer(data.tobytes(), kind), offsets // kind.itemsize


_SPANS = "doc_id long, starts binary, sizes binary"


def _span_rows(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """Spans by document."""
    order = np.argsort(doc, kind="stable")
    doc, start, size = doc[order], start[order], size[order]
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    cuts = np.append(cut, len(doc))
    return [pa.array(doc[cut], pa.int64()), _blobs(start.astype(np.int64), cuts), _blobs(size.astype(np.int64), cuts)]


# --- 1. shared anchors -----------------------------------------------------------------


def _by_hash(sig: np.ndarray) -> np.ndarray:
    """The order of the hashes by their upper 40 bits or more, those that are alike in these as they come."""
    if len(sig) >> 24:
        return np.argsort(sig, kind="stable")
    low = np.uint64((1 << len(sig).bit_length()) - 1)
    return (np.sort((sig & ~low) | np.arange(len(sig), dtype=np.uint64)) & low).astype(np.int64)


def shared_anchors(docs: DataFrame, n_bytes: int, hot: int, length: int) -> DataFrame:
    """doc_id and numbers (int32 of its anchors) where other texts have the anchor too; without a doc_id: common anchors."""
    buckets = max(1, -(-n_bytes // 14 // BUCKET_ENTRIES))
    names = ["bucket", "sig", "number", "doc", "text", "several", "count"]

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        """One entry per anchor to its bucket where several documents of this task have it, and those as they are."""
        ids, texts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        by = np.lexsort((ids, texts))  # equal texts: the smallest document's anchors will do
        new = np.append(True, texts[by][1:] != texts[by][:-1])
        chosen = np.zeros(len(ids), bool)
        chosen[by[new]] = True
        base = np.cumsum([0, *[len(h[0]) for h in held]])
        sig, number = np.concatenate([h[2] for h in held]), np.concatenate([h[4] for h in held])
        of = np.concatenate([h[3] + n for h, n in zip(held, base, strict=False)])
        on = np.flatnonzero(chosen[of])
        order = on[_by_hash(sig[on])]  # a document's entries stay together
        sig, number, doc, text = sig[order], number[order], ids[of[order]], texts[of[order]]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        group, begin = np.cumsum(first) - 1, np.flatnonzero(first)
        new_doc = first.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        count = np.bincount(group, new_doc, len(begin)).astype(np.int64)
        several = count > 1
        rows = []
        met = np.flatnonzero(several[group])
        for k, part in enumerate(np.array_split(met, max(1, len(met) // 200_000))):
            if len(part):
                rows.append((-1 - (int(doc[part[0]]) + k) % buckets, sig[:0], number[part], doc[part], text[part], begin[:0], begin[:0]))
        on = np.flatnonzero(~several[group] | first)
        sig, doc, text, number, lead = sig[on], doc[on], text[on], number[on], np.flatnonzero(first[on])
        cuts = np.searchsorted(sig, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64) & _HIGH) if buckets > 1 else np.empty(0, np.int64)
        bounds = np.concatenate([[0], cuts, [len(sig)]])
        lead, count = lead[several], count[several]
        first_of = np.searchsorted(lead, bounds)
        for b in range(buckets):
            lo, hi, mine = bounds[b], bounds[b + 1], slice(first_of[b], first_of[b + 1])
            if hi > lo:
                rows.append((b, sig[lo:hi], number[lo:hi], doc[lo:hi], text[lo:hi], lead[mine] - lo, count[mine]))
        out: dict[str, list] = {n: [] for n in [*names, "known", "texts"]}
        for b, s, n, d, t, lead_at, c in rows:
            known, place = np.unique(d, return_inverse=True)
            texts = np.zeros(len(known), np.uint64)
            texts[place] = t
            out["bucket"].append(b)
            six = s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
            for name, x in (("sig", six), ("number", n.astype(np.uint32 if n.max() >> 16 else np.uint16)), ("doc", place.astype(np.uint32 if len(known) >> 16 else np.uint16)), ("known", known), ("texts", texts), ("several", lead_at.astype(np.int32)), ("count", c.astype(np.int64))):
                out[name].append(np.ascontiguousarray(x).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), *[pa.array(out[n], pa.binary()) for n in _BLOBS]], ["bucket", *_BLOBS])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, offsets = text_bytes(batch.column("text"))
                a = Anchors(data, offsets, length)
                text = np.array([int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8).digest(), "little") for x, y in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
                held.append((batch.column("doc_id").to_numpy(), text, a.hash, a.text, a.number))
                if sum(len(x[2]) for x in held) > FLUSH:
                    yield from emit(held)
                    held = []
        if sum(len(x[2]) for x in held):
            yield from emit(held)

    def meet(table: pa.Table) -> pa.Table:
        sig, doc, text, number, count = [], [], [], [], []
        for s, n, d, known, texts, lead, c in zip(*[table.column(x).to_pylist() for x in _BLOBS], strict=True):
            known, texts, lead = np.frombuffer(known, np.int64), np.frombuffer(texts, np.uint64), np.frombuffer(lead, np.int32)
            place = np.frombuffer(d, np.uint32 if len(known) >> 16 else np.uint16)
            full = np.zeros((len(s) // 6, 8), np.uint8)
            full[:, 2:] = np.frombuffer(s, np.uint8).reshape(-1, 6)
            sig.append(full.reshape(-1).view("<u8"))
            doc.append(known[place])
            text.append(texts[place])
            number.append(np.frombuffer(n, np.uint16 if len(n) == 2 * len(place) else np.uint32).astype(np.int32))
            several = np.zeros(len(place), np.int64)
            several[lead] = np.frombuffer(c, np.int64)
            count.append(several)
        doc, number, common = np.concatenate(doc), np.concatenate(number), np.empty(0, np.uint64)
        if table.column("bucket")[0].as_py() >= 0:
            sig, text, count = np.concatenate(sig), np.concatenate(text), np.concatenate(count)
            order = np.argsort(sig, kind="stable")
            sig, doc, text, number, count = sig[order], doc[order], text[order], number[order], count[order]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            group, begin = np.cumsum(first) - 1, np.flatnonzero(first)
            new = first.copy()
            new[1:] |= text[1:] != text[:-1]
            total = np.bincount(group, np.maximum(new, count), len(begin))
            shared = np.logical_or.reduceat((text != text[begin][group]) | (count > 1), begin)
            common = sig[begin[total > hot]]
            doc, number = doc[shared[group]], number[shared[group]]
        part = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(1, buckets))
        rows = [(p, d.tobytes(), n.tobytes()) for p, (d, n) in enumerate(zip(np.split(doc[order], cut), np.split(number[order], cut), strict=True)) if len(d)]
        rows += [(-1, b"", common.tobytes())] if len(common) else []
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "docs", "numbers"])

    def by_document(table: pa.Table) -> pa.Table:
        numbers = b"".join(table.column("numbers").to_pylist())
        if table.column("part")[0].as_py() < 0:
            return pa.table([pa.array([None], pa.int64()), pa.array([numbers], pa.binary())], names=["doc_id", "numbers"])
        doc, number = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64), np.frombuffer(numbers, np.int32)
        order = np.argsort(doc, kind="stable")
        doc, number = doc[order], number[order]
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        return pa.table([pa.array(doc[cut]), pa.array([x.tobytes() for x in np.split(number, cut[1:])], pa.binary())], names=["doc_id", "numbers"])

    blobs = docs.mapInArrow(index, "bucket long, " + ", ".join(f"{n} binary" for n in _BLOBS))
    met = blobs.groupBy("bucket").applyInArrow(meet, "part long, docs binary, numbers binary")
    return met.groupBy("part").applyInArrow(by_document, "doc_id long, numbers binary")


_BLOBS = ["sig", "number", "doc", "known", "texts", "several", "count"]
_SIX = ~np.uint64(0xFFFF)

# --- 2. and 3. segments and shards ------------------------------------------------------


def covered_spans(docs: DataFrame, common: np.ndarray, shards: int, length: int) -> DataFrame:
    """docs: doc_id, text, lists (binary numbers of shared anchors). Spans by document, any number of rows each."""
    hot_ones = docs.sparkSession.sparkContext.broadcast(np.sort(common))  # bounded, see HOT_SHARE
    names, kind = ["shard", "doc_id", "x", "y", "of", "doc", "start"], np.uint8 if length < 128 else np.int32

    def picked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shard, bytes, size, document and start of the segments that go on."""
        data, offsets = text_bytes(batch.column("text"))
        data = np.ascontiguousarray(data)
        a = Anchors(data, offsets, length)
        lists = [np.unique(np.frombuffer(b"".join(x), np.int32)) for x in batch.column("lists").to_pylist()]
        bounds = np.searchsorted(a.text, np.arange(batch.num_rows))
        pick = np.concatenate([b + x for b, x in zip(bounds, lists, strict=True)]) if len(a.start) else np.empty(0, np.int64)
        at, n, sig, text = a.start[pick], a.n[pick], a.hash[pick] & _SIX, a.text[pick]
        hot = np.isin(sig, hot_ones.value)
        windows, of = spread(at[hot], n[hot]), np.repeat(np.flatnonzero(hot), n[hot])
        at = np.concatenate([at[~hot], windows])
        size = np.concatenate([n[~hot] + length - 1, np.full(len(windows), length)])
        text = np.concatenate([text[~hot], text[of]])
        shard = (sig[~hot] >> np.uint64(20)) % np.uint64(shards)
        own = span_hashes(_words(data), windows, np.full(len(windows), length))[0] % np.uint64(shards) + np.uint64(shards)
        return np.concatenate([shard, own]).astype(np.int64), _bytes(data, at, size), size, batch.column("doc_id").to_numpy()[text], at - offsets[text]

    def lot(held: list) -> Iterator[pa.RecordBatch]:
        """What equal segments of the lot cover, by document, and one row a shard."""
        shard, data, size, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(size):
            return
        s = Segments(shard, data, np.cumsum(size) - size, size, doc, start)
        spans = _span_rows(*s.covered)
        none = pa.nulls(len(spans[0]), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(none), -1)), *spans, none, none, none], names)
        place = np.cumsum(s.size) - s.size
        order = np.argsort(s.key, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = rank[s.of]
        by = np.argsort(of, kind="stable")
        of, key, size = of[by], s.key[order], s.size[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cuts = np.append(cut, len(key))
        ends, rows = np.append(0, np.cumsum(size))[cuts], np.searchsorted(of, cuts)
        of = (of - np.repeat(cut, np.diff(rows))).astype(np.int32)
        columns = [_blobs(_bytes(s.data, place[order], size), ends), _blobs(size.astype(kind), cuts), _blobs(of, rows), _blobs(s.doc[by], rows), _blobs(s.start[by], rows)]
        yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.nulls(len(cut), pa.int64()), *columns], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for whole in batches:
            for batch in slices(whole, "text"):
                held.append(picked(batch))
                if sum(len(x[1]) for x in held) > LOT_BYTES:
                    yield from lot(held)
                    held = []
        if held:
            yield from lot(held)

    def settle(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        data, _ = _values(table, "x", np.uint8)
        size, rows = _values(table, "y", kind)
        of, places = _values(table, "of", np.int32)
        size, of = size.astype(np.int64), of + np.repeat(rows[:-1], np.diff(places))
        at = (np.cumsum(size) - size)[of]
        seg = Segments(at, data, at, size[of], _values(table, "doc", np.int64)[0], _values(table, "start", np.int64)[0])
        spans = [seg.covered]
        if number < shards:
            spans.append(common_windows(seg, length))
        return pa.table(_span_rows(*(np.concatenate(v) for v in zip(*spans, strict=True))), names=["doc_id", "starts", "sizes"])

    dealt = docs.mapInArrow(deal, "shard long, doc_id long, x binary, y binary, of binary, doc binary, start binary")
    mixed = dealt.withColumn("shard", F.when(F.col("shard") < 0, -1 - F.pmod("doc_id", F.lit(shards))).otherwise(F.col("shard")))

    def group(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return table.select(["doc_id", "x", "y"]).rename_columns(["doc_id", "starts", "sizes"])
        return settle(table)

    return mixed.groupBy("shard").applyInArrow(group, _SPANS)


def common_windows(s: Segments, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, start, size) of windows that different segments share and a smaller document has."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    on = meeting(s, length)
    if not len(on):
        return nothing
    size = s.size[on]
    low, n = repeated_windows(_bytes(s.data, (np.cumsum(s.size) - s.size)[on], size), size, s.owner[on], length)
    # low: windows as positions in those segments' bytes; the segment, and all places where its document has it
    end = np.cumsum(size)
    k = np.searchsorted(end, low, "right")
    inner = low - (end - size)[k]
    if not len(low):
        return nothing
    seg = on[k]
    by = np.argsort(s.of, kind="stable")
    lo, hi = np.searchsorted(s.of[by], seg, "left"), np.searchsorted(s.of[by], seg, "right")
    place = by[spread(lo, hi - lo)]
    return s.doc[place], s.start[place] + np.repeat(inner, hi - lo), np.repeat(n, hi - lo)


def meeting(s: Segments, length: int) -> np.ndarray:
    """Numbers of the segments that may share a window with another owner's.

    A window has its anchor in the same place wherever it is, with half of its other
    bytes or more on the left of it, or more than half on the right. So equal windows
    are in segments that are alike in their anchor and in one of these halves; most that
    share an anchor by chance are alike in neither, and the more text the more of them.
    """
    if not len(s.size):
        return np.empty(0, np.int64)
    at, rest = np.cumsum(s.size) - s.size, length - GRAM
    gram, least = _grams(s.data), np.full(len(at), np.iinfo(np.uint64).max)
    for i in range(rest + 1):  # the anchor of the segment's first window
        np.minimum(least, (gram[at + i] & _HIGH) | np.uint64(i), out=least)
    anchor, words = (least & ~_HIGH).astype(np.int64), _words(s.data)
    left, right = rest // 2, rest - rest // 2 + 1
    found = np.zeros(len(at), bool)
    for on, before, size in ((anchor >= left, left, left + GRAM), (anchor + GRAM + right <= s.size, 0, GRAM + right)):
        on = np.flatnonzero(on)
        h = span_hashes(words, (at + anchor)[on] - before, np.full(len(on), size))[0]
        order = np.argsort(h, kind="stable")
        on, h = on[order], h[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        if len(begin):
            owner = s.owner[on]
            several = np.minimum.reduceat(owner, begin) < np.maximum.reduceat(owner, begin)
            found[on[several[np.cumsum(new) - 1]]] = True
    return np.flatnonzero(found)


def repeated_windows(data: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and sizes of runs of windows that a smaller owner's string has too."""
    stop = 0xFF  # not in UTF-8
    n = len(data) + len(size)
    text = np.full(n + 72, stop, np.uint8)
    text[spread(np.cumsum(size + 1) - size - 1, size)] = data
    order, rank = suffix_order(text, n, length)
    prefix = bounded_prefixes(text, order, length, stop)
    string = np.repeat(np.arange(len(size)), size + 1)
    inner = np.arange(n) - (np.cumsum(size + 1) - size - 1)[string]
    valid = inner <= size[string] - length
    group = np.cumsum(prefix[:-1] >= 0)[rank]  # a set prefix begins a new interval
    w = np.flatnonzero(valid)
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[w], owner[string[w]])
    w = w[owner[string[w]] > least[group[w]]]
    if not len(w):
        return w, w
    new = np.append(True, w[1:] != w[:-1] + 1)
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(w)))
    return w[first] - string[w[first]], runs + length - 1


def suffix_order(text: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text[:n] in the order of their first ``length`` bytes or more, and each one's place."""
    words = _words(text, big=True)[:n].astype(np.uint64)
    order = np.argsort(words)
    rank, first = np.empty(n, np.int64), np.ones(n, bool)  # rank: the place of the first suffix that is alike so far
    first[1:] = words[order[1:]] != words[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    depth = 8
    while depth <= length:
        open_ = np.flatnonzero(~(first & np.append(first[1:], True)))  # places of suffixes that aren't told apart yet
        if not len(open_):
            break
        at = order[open_]
        after = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        first[open_[1:]] = key[1:] != key[:-1]
        rank[at] = open_[np.maximum.accumulate(np.where(first[open_], np.arange(len(at)), 0))]
        depth *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def bounded_prefixes(text: np.ndarray, order: np.ndarray, length: int, stop: int) -> np.ndarray:
    """Common prefix of each suffix in order with the one before, where it is under ``length``; -1 where not, and n + 1 entries.

    Intervals of suffixes that begin alike grow backward on the Burrows-Wheeler
    transform, all of one length at a time. The end of an interval that is one byte
    longer, if nothing set it before, has the level as its prefix and is expanded next.
    """
    n = len(order)
    byte = text[order - 1]  # of suffix 0 too: it comes after the last byte, a stop
    byte[order == 0] = stop
    back = np.empty(n, np.int32)
    back[np.argsort(byte, kind="stable")] = np.arange(n)
    prefix = np.full(n + 1, -1, np.int32)
    prefix[0] = prefix[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for level in range(length):
        at = spread(lo, hi - lo)
        own = np.repeat(np.arange(len(lo)), hi - lo)
        c = byte[at]
        on = c != stop
        at, own, c = at[on], own[on], c[on]
        by = np.argsort(c, kind="stable")  # intervals are in order, so this orders their images
        image, own, c = back[at[by]], own[by], c[by]
        if not len(image):
            break
        new = np.append(True, (image[1:] != image[:-1] + 1) | (own[1:] != own[:-1]) | (c[1:] != c[:-1]))
        first = np.flatnonzero(new)
        begin, end = image[first], image[np.append(first[1:], len(image)) - 1] + 1
        fresh = prefix[end] < 0
        lo, hi = begin[fresh], end[fresh]
        prefix[hi] = level
        if level == 0:  # whole first-byte intervals, also the last one
            lo, hi = begin, end
    return prefix


# --- 4. removal -------------------------------------------------------------------------


def _merge(starts: list[bytes], sizes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as starts and ends."""
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(b"".join(starts), np.int64)
    b = a + np.frombuffer(b"".join(sizes), np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(a) else b
    new = np.append(True, a[1:] > b[:-1]) if len(a) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1] if len(a) else b


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text (binary), copy (of an earlier text), starts and sizes (lists of binary; null without spans)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).where("doc_id is not null")
    every, (docs, again) = docs, first_texts(docs)
    sizes = keep(docs.select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("n")))
    first = keep(sizes.groupBy("h").agg(F.min("doc_id").alias("rep")))  # its own table: the join can split a large class
    classes = keep(sizes.join(first, "h").select("doc_id", "rep", "n"))
    total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = keep(shared_anchors(docs, total[1], max(HOT_LEAST, int(HOT_SHARE * total[0])), length))
    common = [np.frombuffer(r.numbers, np.uint64) for r in found.where("doc_id is null").collect()]  # bounded, see HOT_SHARE
    shared = found.where("doc_id is not null").join(classes.select("doc_id", "rep"), "doc_id").groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list("numbers").alias("lists"))
    entries = found.where("doc_id is not null").agg(F.coalesce(F.sum(F.octet_length("numbers")), F.lit(0))).first()[0] // 4
    shards = max(1, -(-entries * (2 * length - GRAM) // SHARD_BYTES))  # a segment's size is less than that
    marked = docs.join(shared, "doc_id")
    spans = covered_spans(marked, np.concatenate([np.empty(0, np.uint64), *common]), shards, length)
    grouped = spans.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"), F.collect_list("sizes").alias("sizes"))
    copies = classes.where("doc_id <> rep").select("doc_id", F.lit(True).alias("copy"))
    found = grouped.join(copies, "doc_id", "full")
    if again is None:
        return docs.join(found, "doc_id", "left")
    rows = every.join(again.withColumnRenamed("text", "first"), "doc_id", "left").join(found, "doc_id", "left")
    own = F.col("first").isNull() | (F.col("first") == F.col("text"))
    return rows.select("doc_id", "text", *[F.when(own, F.col(c)).alias(c) for c in ("copy", "starts", "sizes")])


def _removed(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Each row's text and the starts and ends of what goes."""
    for text, copy, a, b in zip(*[batch.column(c).to_pylist() for c in ("text", "copy", "starts", "sizes")], strict=True):
        if copy and len(text) >= length:
            yield text, np.array([0]), np.array([len(text)])
        else:
            yield text, *_merge(a or [], b or [])


def _kept(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    ends = [0, *b.tolist()]
    return b"".join(text[x:y] for x, y in zip(ends, [*a.tolist(), len(text)], strict=True))


def removal_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(t), int((b - a).sum()), len(a), hashlib.sha256(_kept(t, a, b)).hexdigest()) for t, a, b in _removed(batch, length)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, length).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (binary) and removed (array of start, end) of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_kept(t, a, b), [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]) for t, a, b in _removed(batch, length)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], kind)], ["doc_id", "kept", "removed"])

    return with_spans(docs, length).mapInArrow(cut, "doc_id long, kept binary, removed array<struct<start: bigint, end: bigint>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(rows_of(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op2_substring_dedup": op2_substring_dedup}
#: By hexadecimal digits: strings of 50 bytes, their smallest document, and the runs of those that begin elsewhere too.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT doc_id, q, substr(h, 512 * q + 1, 610) AS h FROM (SELECT doc_id, h, unnest(range((len(h) // 2 - 50) // 256 + 1)) AS q FROM d WHERE len(h) >= 100)),
w AS (SELECT doc_id, 256 * q + i AS i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, q, h, unnest(range(len(h) // 2 - 49)) AS i FROM q)),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, i FROM w JOIN m USING (g) WHERE doc_id > first),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM s),
k AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
ORACLES = {"op2_substring_dedup": SQL}
