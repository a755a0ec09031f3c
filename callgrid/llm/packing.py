"""Best-fit packing by a configuration linear program over the length histogram.

Tokenising tasks give each piece a rank among the equally long pieces of its task; counts per task and length, summed
over the tasks before it, make that a rank among all equally long pieces without gathering a length anywhere. The
histogram (at most one count per length) goes to the driver, which plans in bounded size: lengths are grouped into
classes, the covering program "fewest configurations that hold all pieces" is solved by multiplicative weights, with a
knapsack dynamic program pricing the next configuration, and its solution is rounded to configurations of exact
lengths, gaps and remainders filled best-fit. The plan says which ranks of a length go to which sequences and offsets;
at most a few rows per length and configuration, it is looked up by every task.

Defined results: null and empty texts are the end id alone. Repeated rows are packed separately. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.runtime import by_value, per_process, slices, stage

by_value(__name__)

CAPACITY, END_ID, CLASSES, ROUNDS, CACHE = 4096, 1, 128, 300, 200_000
#: Shares of the program's solution that are rounded down to whole configurations; the best of these roundings is used.
SHARES = (0.25, 0.5, 0.75, 1.0)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


#: Runs of one Latin word between plain punctuation: the tokenizer's own pattern cuts them at exactly these borders, and
#: its normaliser only lower-cases them. Apostrophes, digits and angle brackets (special tokens) are left to it.
MARKS = r"[!\"#$%&()*+,\-./:;=?@\[\]^_{|}~]*"
PLAIN = f"^(?P<a>{MARKS})(?P<w>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)(?P<b>{MARKS})$"


class Encoder:
    """Token ids as little-endian uint32 bytes. Every step of the tokenizer works inside a run of non-blanks, so distinct
    runs are encoded once. Plain runs are taken apart into punctuation and a lower-cased word; words are remembered, and
    new ones encoded many at a time and cut apart at the tokens that end a word."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_str(vocabulary), {"": b""}
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _each(self, texts: list[str], into: dict) -> None:
        for i in range(0, len(texts), 4096):
            part = texts[i : i + 4096]
            for t, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                into[t] = np.array(e.ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> None:
        for i in range(0, len(words), 128):
            part = words[i : i + 128]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                self._each(part, self.parts)
                continue
            data, at = ids.tobytes(), 0
            for w, to in zip(part, (4 * cut).tolist(), strict=True):
                self.parts[w] = data[at:to]
                at = to

    def _ids(self, texts: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text, where its ids begin in one array of ids, and how many there are."""
        numbered = texts.dictionary_encode()
        keys = numbered.dictionary.to_pylist()
        encode([k for k in keys if k not in self.parts])
        found = [self.parts[k] for k in keys]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = numbered.indices.to_numpy()
        return np.frombuffer(b"".join(found), "<u4"), (np.cumsum(n) - n)[codes], n[codes]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Texts are cut at blanks and their distinct runs taken apart by vectorised steps; Python sees distinct words only."""
        if len(self.parts) > CACHE:
            self.parts.clear()
            self.parts[""] = b""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        numbered = cut.flatten().dictionary_encode()
        runs, codes = numbered.dictionary, numbered.indices.to_numpy()
        apart = pc.extract_regex(runs, PLAIN)
        plain = apart.is_valid().to_numpy(zero_copy_only=False)
        # three parts of each run: punctuation, word, punctuation; other runs are one part
        whole = pc.if_else(pa.array(plain), pa.scalar(""), runs)
        a, w, b = (pc.fill_null(apart.field(i), "") for i in range(3))
        marks = self._ids(pa.concat_arrays([a, b, whole]), lambda new: self._each(new, self.parts))
        words = self._ids(pc.utf8_lower(w), self._words)
        for texts in (whole, pc.utf8_lower(w)):  # very long runs and words are not remembered
            for text in texts.filter(pc.greater(pc.utf8_length(texts), 64)).to_pylist():
                self.parts.pop(text, None)
        k = len(runs)
        base = np.concatenate([marks[0], words[0]])
        first = np.stack([marks[1][:k], words[1] + len(marks[0]), marks[1][k : 2 * k], marks[1][2 * k :]], 1)
        size = np.stack([marks[2][:k], words[2], marks[2][k : 2 * k], marks[2][2 * k :]], 1)
        ids, n = self._gathered(base, first.ravel(), size.ravel()), size.sum(1)
        ends = np.concatenate([[0], np.cumsum(n[codes])])
        data = self._gathered(ids, (np.cumsum(n) - n)[codes], n[codes]).tobytes()
        of = (4 * ends[cut.offsets.to_numpy()]).tolist()
        return [data[lo:hi] for lo, hi in zip(of[:-1], of[1:], strict=True)]

    @staticmethod
    def _gathered(base: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Stretches of an array, one after the other."""
        ends = np.cumsum(n)
        return base[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def tokenised(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """PIECES of every row; only documents of more than ``capacity`` ids are cut."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: fixed size
    name = f"encoder_{zlib.crc32(vocabulary.encode()):08x}"

    def run(batches):
        import gc
        import os

        gc.disable()  # millions of strings and no cycles
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, seen = per_process(name, lambda: Encoder(sent.value)), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, names, kinds = np.array([end_id], "<u4").tobytes(), [x.split()[0] for x in PIECES.split(", ")], (pa.int64(), pa.int32(), pa.int64(),
            pa.int64(), pa.int64(), pa.int32(), pa.int64())
        try:
            for b in slices(batches, 2048):
                rows = []
                for doc, data in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        finally:  # also where the task stops early: the worker goes on to others
            gc.enable()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def price(values: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Bounded knapsack by dynamic programming over capacities: how often the best configuration holds each class."""
    best, lots, taken = np.zeros(capacity + 1), [], []
    for k, (size, value, limit) in enumerate(zip(sizes.tolist(), values.tolist(), np.minimum(most, capacity // sizes).tolist(), strict=True)):
        lot = 1
        while limit > 0:  # limit as a sum of powers of two and a rest
            lot = min(lot, limit)
            cost = lot * size
            more = best[: capacity + 1 - cost] + lot * value
            better = more > best[cost:]
            np.copyto(best[cost:], more, where=better)
            lots.append((k, lot, cost))
            taken.append(better)
            limit, lot = limit - lot, 2 * lot
    times, c = np.zeros(len(sizes), np.int64), capacity
    for (k, lot, cost), better in zip(reversed(lots), reversed(taken), strict=True):
        if c >= cost and better[c - cost]:
            times[k] += lot
            c -= cost
    return times


def configurations(counts: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[float, np.ndarray]]:
    """Covering program by multiplicative weights: (how often, times of each class).

    The weight of a class falls with the share of its pieces that the configurations so far hold; it starts at the
    class's share of all tokens, the optimal price where volume alone decides.
    """
    n = counts.astype(float)
    weight, cover, found = sizes * n, np.zeros(len(n)), {}
    for _ in range(rounds):
        times = price(weight / n, sizes, counts, capacity)
        own = times > 0
        if not own.any():
            break
        step = 0.25 * (n[own] / times[own]).min()
        share = times * step / n
        cover += share
        weight = weight * np.exp(-2.0 * share)
        weight /= weight.sum()
        key = times.tobytes()
        found[key] = found.get(key, 0.0) + step
        if cover.min() >= 2:
            break
    scale = max(1e-12, float((cover * sizes * n).sum() / (sizes * n).sum()))
    return sorted(((x / scale, np.frombuffer(k, np.int64)) for k, x in found.items()), key=lambda c: -c[0])


class Stock:
    """Counts of lengths left, with the largest left at or below any length in near constant time."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).tolist()
        self.below = list(range(len(self.left)))  # union-find towards smaller lengths

    def at_most(self, n: int) -> int:
        path = []
        while n > 0 and (self.left[n] == 0 or self.below[n] != n):
            path.append(n)
            n = self.below[n] if self.below[n] != n else n - 1
        for p in path:
            self.below[p] = n
        return n


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, how many sequences) from counts by length 0..capacity. Holds every piece exactly once."""
    lengths = np.flatnonzero(histogram[1:]) + 1
    if not len(lengths):
        return []
    mass = np.cumsum(histogram[lengths] * lengths)
    last = np.arange(len(lengths)) if len(lengths) <= CLASSES else np.unique(np.minimum(np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES
        + 1) / CLASSES), len(lengths) - 1))
    tops = lengths[last]
    lows = np.concatenate([[0], tops[:-1]])
    counts = np.array([histogram[lo + 1 : hi + 1].sum() for lo, hi in zip(lows, tops, strict=True)])
    sizes = -(-np.diff(mass[last], prepend=0) // counts)
    found = sorted(configurations(counts, sizes, capacity), key=lambda c: -np.flatnonzero(c[1]).max())
    classes = list(zip(lows.tolist(), sizes.tolist(), tops.tolist(), strict=True))[::-1]
    chosen = [(x, [w for w, t in zip(classes, reversed(times.tolist()), strict=True) for _ in range(t)]) for x, times in found]
    return min((rounded(histogram, chosen, share, capacity) for share in SHARES), key=lambda p: sum(n for _, n in p))


def rounded(histogram: np.ndarray, chosen: list, share: float, capacity: int) -> list[tuple[list[int], int]]:
    """Whole configurations of exact lengths from fractional ones of classes; what is left is placed best-fit."""
    stock, out = Stock(histogram), []

    def place(wanted: list[tuple[int, int, int]], limit: int) -> int:
        """One exact configuration, as often as ``limit`` and the stock allow.

        Each wanted class (lo, mean, hi) gives the length that leaves room for the means of the rest; then the gap is
        filled best-fit.
        """
        used, gap, used_of, rest = [], capacity, {}, sum(w[1] for w in wanted)

        def take(hi: int, lo: int = 0) -> bool:
            nonlocal gap
            n = stock.at_most(min(hi, gap)) if hi > lo else 0
            if n <= lo:
                return False
            used.append(n)
            used_of[n] = used_of.get(n, 0) + 1
            stock.left[n] -= 1
            gap -= n
            return True

        for lo, mean, hi in wanted:
            rest -= mean
            if not take(min(hi, gap - rest), lo):
                take(hi, lo)
        while gap and take(gap):
            pass
        if not used:
            return 0
        again = min([limit - 1, *(stock.left[n] // k for n, k in used_of.items())])
        for n, k in used_of.items():
            stock.left[n] -= k * again
        out.append((used, 1 + again))
        return 1 + again

    for x, wanted in chosen:
        todo = int(x * share)
        while todo > 0 and wanted[0][0] < stock.at_most(wanted[0][2]):
            todo -= place(wanted, todo)
    while stock.at_most(capacity):
        place([], 1 << 60)
    return out


def lookup(configs: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length << 48 | first rank, first sequence, offset, times in the sequence), sorted by the first."""
    rows, upto, sequence = [], {}, 0
    for used, n in configs:
        offset = 0
        for length in sorted(set(used), reverse=True):
            k = used.count(length)
            rank = upto.get(length, 0)
            rows.append((length << 48 | rank, sequence, offset, k))
            upto[length] = rank + k * n
            offset += k * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECES rows with sequence_id and offset. ``pieces`` is a staged table: its ranks must not be made anew."""
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["count"]
    table = lookup(plan(histogram, capacity))
    sent = pieces.sparkSession.sparkContext.broadcast(table)  # bounded by lengths and configurations, not by rows
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = pieces.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches):
        plan_rows = sent.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(plan_rows[:, 0], (length << 48) | rank, side="right") - 1
            key, sequence, offset, k = plan_rows[at].T
            j = rank - (key & ((1 << 48) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence + j // k), pa.array(offset + (j % k) * length)], names=["doc_id", "piece",
                "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    pieces = stage(tokenised(docs, vocabulary_text(tokenizer_path or default_vocabulary())), "pieces")
    return pack(pieces)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
