"""Best-fit packing of token pieces into sequences, by a linear grouping scheme.

Documents are encoded, cut into pieces of at most ``capacity`` tokens, and counted by
length. A length is at most the capacity, so the counts are a bounded summary of any
corpus; the plan is made from them alone and says, for runs of pieces of a length by
their rank, which sequences and offsets they take:

1. lengths over a fifth of the capacity are large; sorted, they are cut into groups of
   equal cardinality and rounded up to their group's largest length; as many lengths as
   there may be groups, or fewer, are a group each;
2. configurations of these few sizes are optimised by column generation (a linear
   program whose new columns are knapsacks of at most four pieces), and rounded down;
3. actual lengths take the places of the rounded ones, longest first, the last place of a
   sequence what the others leave room for;
4. large pieces left over and all small ones go, longest first, where they fit best.

Step 3 leaves sequences some room, and small pieces may not fill it. So it is tried with
several least rooms below which a sequence (but a full one) is given up again, and where that
comes to more than a thousandth above the tokens' bound, also without filling sequences in
twos. The plan with the fewest sequences is taken, of equal ones that which gives up least.

Ranks within a length are counted in two steps (salted counts, then places in a salt),
so no task gets all pieces of a common length.

Null text is empty: one piece, the end token. Each row is a document, repeated rows
too; rows without an id are packed with a null id. Other columns are ignored. An empty
table has no pieces.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from studyloom.llm._store import keep, rows_of
from studyloom.llm._text import NOT_SPACE, Words, byte_class, slices, spread, text_bytes

CAPACITY = 2048
END = 0
GROUPS = 160
LARGE_SHARE = 5
#: Sequences whose room after step 3 is less than this, but not 0, are undone; tried in turn.
LEAST_ROOMS = (1, 8, 32, 64, 128, 256)
#: Lengths that are looked at for a place whose sequence the next one is to fill.
EXACT = 256
#: A plan is near enough to the bound if it has one sequence more for so many.
NEAR = 1000
#: Words that an encoder remembers; beyond, it starts anew.
KNOWN_WORDS = 1_000_000
SALT_ROWS = 20_000

_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
_STOP = np.isin(np.arange(256), list(b".,"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and lower-cases, so that each word can be encoded once.

    Words are what ASCII white space separates; a single full stop or comma after an
    ASCII letter is a word of its own. The tokenizer splits at both places as well. Known
    words are found by their 64-bit hash. Texts that may name special tokens are encoded
    whole.
    """

    def __init__(self, vocabulary: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(vocabulary), end
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a pre-token
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.code = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes, and their numbers
        self.fresh, self.fresh_code = self.known, self.code  # what came since they were last merged
        self.pool, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.at, self.n = np.zeros(1 << 16, np.int64), 0

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if all(map(str.isalpha, words)):  # each is one pre-token, as long as lower-casing keeps it letters
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        each = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.uint32), np.array(list(map(len, each)), np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        for kind in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for part in (kind[i : i + 2000] for i in range(0, len(kind), 2000)):
                ids, lengths = self._ids([words[i] for i in part])
                n, total = self.n + len(part), self.n_ids + len(ids)
                while total > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
                while n >= len(self.at):
                    self.at = np.concatenate([self.at, np.zeros_like(self.at)])
                self.pool[self.n_ids : total] = ids
                self.at[self.n + 1 : n + 1] = self.n_ids + np.cumsum(lengths)
                self.fresh = np.concatenate([self.fresh, hashes[part]])
                self.fresh_code = np.concatenate([self.fresh_code, np.arange(self.n, n)])
                self.n, self.n_ids = n, total
        if len(self.fresh) > len(self.known) // 8:
            self.known, self.code = np.concatenate([self.known, self.fresh]), np.concatenate([self.code, self.fresh_code])
            self.fresh, self.fresh_code = self.known[:0], self.code[:0]
            order = np.argsort(self.known)
            self.known, self.code = self.known[order], self.code[order]
        else:
            order = np.argsort(self.fresh)
            self.fresh, self.fresh_code = self.fresh[order], self.fresh_code[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for known, code in ((self.known, self.code), (self.fresh, self.fresh_code)):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, code[at], out)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and n + 1 offsets."""
        n = len(offsets) - 1
        mark = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) else np.empty(0, np.int64)
        whole = set((np.searchsorted(offsets, mark, "right") - 1).tolist())
        stop = np.flatnonzero(_STOP[data])
        before, after = np.maximum(stop - 1, 0), np.minimum(stop + 1, len(data) - 1)
        first, last = np.isin(stop, offsets[:-1]), np.isin(stop + 1, offsets)
        stop = stop[_LETTER[data[before]] & ~first & (_SPACE[data[after]] | last)]
        text = np.insert(data, stop, 32)
        words = Words(text, offsets + np.searchsorted(stop, offsets), NOT_SPACE)
        if self.n > KNOWN_WORDS:
            self._forget()
        distinct, of = np.unique(words.hash, return_inverse=True)
        code = self._find(distinct)
        if len(new := np.flatnonzero(code < 0)):
            example = np.empty(len(distinct), np.int64)
            example[of] = np.arange(len(of))
            raw = words.data.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(words.start[example[new]].tolist(), words.end[example[new]].tolist(), strict=True)])
            code = self._find(distinct)
        code = code[of]
        length = self.at[code + 1] - self.at[code]
        edge = np.concatenate([[0], np.cumsum(length)])[words.at]
        sizes = np.diff(edge) + 1
        other = {t: np.array(self.tokenizer.encode(data[offsets[t] : offsets[t + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for t in whole}
        for t, ids in other.items():
            sizes[t] = len(ids) + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(at[-1], self.end, np.uint32)
        if not other:
            place = np.ones(len(out), bool)
            place[at[1:] - 1] = False
            out[place] = self.pool[spread(self.at[code], length)]
        else:
            ids = self.pool[spread(self.at[code], length)]
            for t in range(n):
                out[at[t] : at[t + 1] - 1] = other[t] if t in other else ids[edge[t] : edge[t + 1]]
        return out, at


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(vocabulary: str, end: int = END) -> WordEncoder:
    """The Python worker's encoder, which keeps what it has learned from task to task."""
    if (vocabulary, end) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[vocabulary, end] = WordEncoder(vocabulary, end)
    return _encoders[vocabulary, end]


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; with ids, the ids themselves as well."""
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens, at = encoder(vocabulary).encode(*text_bytes(batch.column("text")))
                n_pieces = -(-np.diff(at) // capacity)
                doc = np.repeat(np.arange(batch.num_rows), n_pieces)
                piece = spread(np.zeros(batch.num_rows, np.int64), n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[doc] - start)
                lo = (at[doc] + start).tolist()
                flat = tokens.astype("<u4")
                runs = [flat[a : a + k] for a, k in zip(lo, length.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(r) for r in runs], pa.int64())]
                columns += [pa.array([r.tolist() for r in runs], pa.list_(pa.int64()))] if ids else []
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if ids else 5])

    return docs.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


# --- the plan, from counts by length ---------------------------------------------------


def linear_groups(counts: np.ndarray, least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Lengths from the longest down to ``least`` as (length, pieces), cut into groups of about equal cardinality."""
    total, lengths = int(counts[least:].sum()), np.flatnonzero(counts[least:])[::-1] + least
    if not total:
        return []
    if len(lengths) <= groups:
        return [[(int(x), int(counts[x]))] for x in lengths]
    size, out, room = -(-total // groups), [[]], -(-total // groups)
    for length in lengths.tolist():
        n = int(counts[length])
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def best_knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The counts of at most four sizes of the largest value that fit the capacity, by pairs of pairs."""
    m = len(sizes)
    worth = np.append(np.maximum(values, 0), 0.0)  # the last one is no piece
    size = np.append(sizes, 0)
    a, b = np.triu_indices(m + 1)
    total, gain = size[a] + size[b], worth[a] + worth[b]
    order = np.lexsort((-gain, total))
    order = order[total[order] <= capacity]
    best, pair = np.full(capacity + 1, -1.0), np.zeros(capacity + 1, np.int64)
    first = order[np.concatenate([[True], np.diff(total[order]) > 0])]
    best[total[first]], pair[total[first]] = gain[first], first
    upto = np.maximum.accumulate(best)  # the best pair within a room, and where it is
    where = np.maximum.accumulate(np.where(best >= upto, np.arange(capacity + 1), 0))
    both = np.where(best >= 0, best + upto[::-1], -1.0)
    at = int(np.argmax(both))
    counts = np.zeros(m + 1, np.int64)
    for k in (pair[at], pair[where[capacity - at]]):
        counts[a[k]] += 1
        counts[b[k]] += 1
    return float(both[at]), counts[:m]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Column generation for the fewest sequences: configurations and whole numbers of times to use them."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = np.linalg.solve(basis, demand.astype(float))
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(m))
        value, column = best_knapsack(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        on = step > 1e-9
        if not on.any():
            break
        ratio = np.where(on, x / np.where(on, step, 1), np.inf)
        leaving = int(np.argmin(ratio))
        x = x - max(ratio[leaving], 0) * step
        x[leaving] = max(ratio[leaving], 0)
        basis[:, leaving] = column
    return [(basis[:, j].round().astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in range(m) if x[j] >= 1 - 1e-9]


class Block:
    """A run of sequences with the same lengths inside; each length goes with the rank of its first piece. planned: how many of them a configuration placed."""

    __slots__ = ("n", "room", "parts", "planned")

    def __init__(self, n: int, room: int, parts: list[tuple[int, int]], planned: int = 0):
        self.n, self.room, self.parts, self.planned = n, room, parts, planned

    def split(self, n: int) -> Block:
        """Takes the first n sequences away, as a block of their own."""
        first = Block(n, self.room, list(self.parts), self.planned)
        self.n -= n
        self.parts = [(length, rank + n) for length, rank in self.parts]
        return first


def substituted(counts: np.ndarray, capacity: int, groups: int, large_share: int, exact: int = EXACT) -> list[tuple[int, list[int]]]:
    """Steps 1 to 3: numbers of sequences, and the actual lengths in them.

    In a configuration the longest piece that is left goes to each place, as far as the place's size allows;
    the last two take the first that fill the sequence, of some of the longest for the first of them, or else
    the last takes the longest that the others leave room for. So rounding up costs next to nothing.
    """
    least = capacity // large_share + 1
    by_size: dict[int, int] = defaultdict(int)
    for g in linear_groups(counts, least, groups):
        by_size[g[0][0]] += sum(n for _, n in g)
    if not by_size:
        return []
    sizes = np.array(sorted(by_size, reverse=True))
    left = {int(x): int(counts[x]) for x in np.flatnonzero(counts[least:]) + least}
    known, out = sorted(left), []
    for pattern, times in configurations(sizes, np.array([by_size[s] for s in sizes]), capacity):
        places = [int(s) for s, n in zip(sizes, pattern, strict=True) for _ in range(int(n))]
        while times:
            lengths: list[int] = []
            for i, size in enumerate(places):
                room = capacity - sum(lengths)
                k = bisect_right(known, size if i + 1 < len(places) else room) - 1
                if i + 2 == len(places):
                    full = (x for x in reversed(known[max(k + 1 - exact, 0) : k + 1]) if left[x] > lengths.count(x) and left.get(room - x, 0) > [*lengths, x].count(room - x))
                    if x := next(full, 0):
                        lengths += [x, room - x]
                        break
                while k >= 0 and left[known[k]] <= lengths.count(known[k]):
                    k -= 1
                if k >= 0:
                    lengths.append(known[k])
            if len(lengths) < len(places):
                break
            n = min(times, *(left[x] // lengths.count(x) for x in lengths))
            out.append((n, lengths))
            times -= n
            for x in lengths:
                left[x] -= n
                if not left[x]:
                    del known[bisect_left(known, x)]
    return out


def plan_blocks(counts: np.ndarray, capacity: int, groups: int = GROUPS, large_share: int = LARGE_SHARE, least_rooms: tuple[int, ...] = LEAST_ROOMS) -> list[Block]:
    """counts[l]: pieces of length l, from 0 to the capacity."""
    bound = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    best: list[Block] | None = None
    for exact in (EXACT, 0):
        placed = substituted(np.append(counts[:capacity], 0), capacity, groups, large_share, exact)
        for least in least_rooms:
            blocks = best_fit(counts, capacity, [p for p in placed if (room := capacity - sum(p[1])) == 0 or room >= least])
            if best is None or sum(b.n for b in blocks) < sum(b.n for b in best):
                best = blocks
            if sum(b.n for b in best) == bound:
                return best
        if sum(b.n for b in best) * NEAR <= bound * (NEAR + 1):
            break
    return best or []


def best_fit(counts: np.ndarray, capacity: int, placed: list[tuple[int, list[int]]]) -> list[Block]:
    """Step 4 on top of what is placed: all other pieces, longest first, where they leave the least room."""
    used = np.zeros(len(counts), np.int64)  # the next rank of each length
    left = counts.astype(np.int64).copy()
    blocks: list[Block] = []

    def take(length: int, n: int) -> int:
        rank = int(used[length])
        used[length] += n
        left[length] -= n
        return rank

    if n := int(left[capacity]):
        blocks.append(Block(n, 0, [(capacity, take(capacity, n))]))
    blocks += [Block(n, capacity - sum(lengths), [(x, take(x, n)) for x in lengths], len(lengths)) for n, lengths in placed]
    rooms: dict[int, list[Block]] = defaultdict(list)
    for b in blocks:
        rooms[b.room].append(b)
    known = sorted(rooms)
    for length in range(capacity - 1, 0, -1):
        while n := int(left[length]):
            k = bisect_left(known, length)
            if k == len(known):
                each = max(1, min(capacity // length, n))
                n = n // each
                b = Block(n, capacity, [])
                for _ in range(each):
                    b.parts.append((length, take(length, n)))
                    b.room -= length
                blocks.append(b)
            else:
                room = known[k]
                b = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], known[k]
                if b.n > n:
                    first = b.split(n)
                    if room not in rooms:
                        insort(known, room)
                    rooms[room].append(b)
                    blocks.append(first)
                    b = first
                b.parts.append((length, take(length, b.n)))
                b.room -= length
            if b.room not in rooms:
                insort(known, b.room)
            rooms[b.room].append(b)
    return blocks


def plan_rows(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset)."""
    out, sequence = [], 0
    for b in plan_blocks(counts, capacity):
        offset = 0
        for length, rank in b.parts:
            out.append((length, rank, rank + b.n, sequence, offset))
            offset += length
        sequence += b.n
    return out


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """Adds each piece's rank within its length, from 0."""
    salts = max(1, -(-n // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("nth", nth).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth") - 1).drop("salt", "nth", "base")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = keep(cut_pieces(docs, vocabulary, capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row per length, at most the capacity
        counts[r["length"]] = r["count"]
    by_length: dict[int, list] = defaultdict(list)
    for length, lo, hi, sequence, offset in sorted(plan_rows(counts, capacity)):
        by_length[length].append((lo, hi, sequence, offset))
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("lo", "hi", "first", "offset")])
    plan = spark.createDataFrame(list(by_length.items()), T.StructType([T.StructField("length", T.LongType()), T.StructField("runs", T.ArrayType(run))]))
    placed = ranked(pieces, int(counts.sum())).join(F.broadcast(plan), "length")  # a row per length: bounded by the capacity
    mine = F.element_at(F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"])), 1)
    return placed.withColumn("run", mine).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.first") + F.col("rank") - F.col("run.lo")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(rows_of(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
