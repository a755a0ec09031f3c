"""Language-model scoring by deleted interpolation of trigram, bigram, unigram and base estimates.

p(w | u v) = a c(u v w)/c(u v) + b c(v w)/c(v) + d c(w)/N + e (c(w)+1)/(N+V+1). The weights (a, b, d, e) belong to the
bucket of the context's frequency: of c(u v) where the pair was seen, else of c(v). They come from
expectation-maximisation on held-out counts: every training token is scored with its own occurrence taken out of all
counts (deleted estimation). A text is its lower-cased words and one end; the end is also the context of the first word,
which has no trigram.

Counting without a row per token: a task turns its documents into chunks of at most ``CHUNK`` tokens. A chunk keeps its
token sequence as ranks in its own sorted word hashes, and asks for the counts of its distinct words, pairs and triples:
blocks of sorted hashes with its own training counts, one for each of at most ``FAN`` ranges of hashes. The task of a
range merges the blocks of all chunks and answers each in the block's own order. Above ``FAN`` chunks, groups of chunks
are merged first and ask in turn, so the blocks grow with the input and not with its square, and a task holds about a
chunk's worth of hashes at every size. Very frequent n-grams are one entry per chunk; every count covers all training
documents.

Words keep 64 bits of hash. Pairs and triples keep as many bits as the corpus has tokens and ``SPARE`` more, so one in
2**SPARE of them shares its count with another, at any size.

EM needs only the ratios of the estimates to the base: chunks gather a histogram of them per bucket (octave bins with
their means; its size is fixed), on which the driver iterates.

Defined results: null text is an empty text, the end alone. Without training documents N is 0 and only the base is left.
Repeated rows are scored and, if in training, counted again. A null doc_id is in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.llm.quality import held_out
from callgrid.llm.text import WordHashes
from callgrid.runtime import by_value, shuffles_dropped, slices, stage, steady_memory, trimmed

by_value(__name__)

CHUNK, FAN, SPARE, CONTEXT_BUCKETS, EM_ROUNDS = 1_000_000, 256, 20, 24, 200
#: EM's histogram: octave bins of trigram to base and bigram to base, octave bins of the word's count.
X_BINS, Y_BINS = 48, 16
END = 0x9E3779B97F4A7C15
#: Arrays of a chunk are below this many bytes; a worker keeps such blocks within a task.
ARRAYS = 1 << 24
WORDS, PAIRS, TRIPLES = 1, 2, 3


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = v * np.uint64(0xD6E8FEB86659FD93) + (w ^ (w >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unsqueeze(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart, so that the high bytes, mostly 0, vanish."""
    d = np.diff(h, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = unsqueeze(b, np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    top = int(c.max()) if len(c) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + squeeze(c.astype(kind))


def unpack_counts(b: bytes) -> np.ndarray:
    return unsqueeze(b[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[b[0]]).astype(np.int64)


def hash_bits(tokens: int) -> int:
    """Bits of the hashes of pairs and triples."""
    return min(64, int(tokens + 2).bit_length() + SPARE)


def ngram_views(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, bits: int):
    """Of each token: its context (a rank in ``words``), and whether it is its text's first. Then the distinct pairs and
    each token's pair, the distinct triples and each token's triple (of a first token, none: its entry means nothing)."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first = np.zeros(len(at), bool)
    first[starts] = True
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[starts] = np.searchsorted(words, np.uint64(END))
    whole = pair_hash(words[before], words[at])
    cut = np.uint64(64 - bits)
    pairs, pair_at = np.unique(whole >> cut, return_inverse=True)
    previous = np.empty_like(whole)
    previous[1:] = whole[:-1]
    previous[0] = 0
    later = ~first
    triples, its = np.unique(pair_hash(previous[later], words[at[later]]) >> cut, return_inverse=True)
    triple_at = np.zeros(len(at), np.int64)
    triple_at[later] = its
    return before, first, pairs, pair_at, triples, triple_at


def _batch(rows, schema: str):
    """Arrow batch of row tuples under a schema like 'a long, b binary'."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


CHUNKS = "chunk string, tokens long, docs binary, keys binary, at binary"


def chunked(docs: DataFrame, chunk_tokens: int = CHUNK) -> DataFrame:
    """CHUNKS rows from (doc_id, text, held_out): documents and sizes, sorted word hashes, each token's rank in them."""

    def close(name, ids, held, parts):
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "held": np.array(held, bool), "size": np.array([len(p) for p in parts], np.int64)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return _batch([(name, len(at), sink.getvalue().to_pybytes(), pack_sorted(words), squeeze(at.astype(np.uint32)))], CHUNKS)

    def run(batches):
        hashes, part, n, tokens = WordHashes(), TaskContext.get().partitionId(), 0, 0
        end, ids, held, parts = np.array([END], np.uint64), [], [], []
        for b in slices(batches, least=ARRAYS):
            for doc, text, out in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.concatenate([hashes.of((text or "").encode()), end])
                if parts and tokens + len(own) > chunk_tokens:
                    yield close(f"{part}-{n}", ids, held, parts)
                    ids, held, parts, tokens, n = [], [], [], 0, n + 1
                ids.append(doc)
                held.append(out)
                parts.append(own)
                tokens += len(own)
        if ids:
            yield close(f"{part}-{n}", ids, held, parts)

    return docs.mapInArrow(run, CHUNKS)


def _sequence(row: dict):
    docs = pa.ipc.open_stream(row["docs"]).read_all()
    return docs, docs.column("size").to_numpy(), unpack_sorted(row["keys"]), unsqueeze(row["at"], np.uint32)


#: A question: sorted distinct hashes of one range, with the asker's own training counts.
BLOCKS = "kind int, range long, owner string, keys binary, counts binary"


def _ranges(kind: int, number: int, owner: str, keys: np.ndarray, counts: np.ndarray, bits: int, done: int, fan: int) -> list:
    """BLOCKS rows of the ``fan`` parts of a range of hashes. ``done``: the leading bits that all hashes of it share."""
    step = fan.bit_length() - 1
    if step == 0:
        return [(kind, number, owner, pack_sorted(keys), pack_counts(counts))] if len(keys) else []
    low = (number << (bits - done)) if done else 0
    cuts = [low + (k << (bits - done - step)) for k in range(1, fan)]
    of = [0, *np.searchsorted(keys, np.array(cuts, np.uint64)).tolist(), len(keys)]
    return [(kind, number * fan + k, owner, pack_sorted(keys[lo:hi]), pack_counts(counts[lo:hi])) for k, (lo, hi) in enumerate(zip(of[:-1], of[1:],
        strict=True)) if hi > lo]


def asked(chunks: DataFrame, bits: int, fan: int) -> DataFrame:
    """BLOCKS of every chunk, by ``fan`` (a power of two) ranges of hashes."""

    def run(batches):
        for b in slices(batches, 1, ARRAYS):
            row = b.to_pylist()[0]
            docs, sizes, words, at = _sequence(row)
            training = np.repeat(~docs.column("held").to_numpy(zero_copy_only=False), sizes)
            _, first, pairs, pair_at, triples, triple_at = ngram_views(words, at, sizes, bits)
            for kind, keys, of, width in ((WORDS, words, at[training], 64), (PAIRS, pairs, pair_at[training], bits), (TRIPLES, triples,
                triple_at[training & ~first], bits)):
                yield _batch(_ranges(kind, 0, row["chunk"], keys, np.bincount(of, minlength=len(keys)), width, 0, fan), BLOCKS)

    return chunks.mapInArrow(run, BLOCKS)


ANSWERS = "kind int, range long, owner string, counts binary, total long, types long"


def _merged(table: pa.Table):
    """The hashes of each block, all distinct ones, their summed counts, and where each block's hashes are in them."""
    steady_memory(ARRAYS)
    keys = [unpack_sorted(k.as_py()) for k in table.column("keys")]
    counts = [unpack_counts(c.as_py()) for c in table.column("counts")]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)  # below 2**53, so exact
    return [len(k) for k in keys], every, sums, at


def _handed(table: pa.Table, sizes: list, totals: np.ndarray, at: np.ndarray) -> list:
    """ANSWERS rows of the blocks of a table."""
    kind, number, ends = table.column("kind")[0].as_py(), table.column("range")[0].as_py(), np.cumsum([0, *sizes])
    return [(kind, number, o, pack_counts(totals[at[lo:hi]]), None, None) for o, lo, hi in zip(table.column("owner").to_pylist(), ends[:-1], ends[1:],
        strict=True)]


def _answer(table: pa.Table) -> pa.Table:
    """A range's total counts, in the order of each block's hashes; a row of kind 0 has the sums over words."""
    sizes, _, totals, at = _merged(table)
    rows = _handed(table, sizes, totals, at)
    if table.column("kind")[0].as_py() == WORDS:
        rows.append((0, None, None, None, int(totals.sum()), int((totals > 0).sum())))
    return pa.Table.from_batches([_batch(rows, ANSWERS)])


def answered(blocks: DataFrame, owners: int, bits: int, done: int, fan: int = FAN) -> DataFrame:
    """ANSWERS to all blocks. ``owners``: about how many blocks a range has; ``done``: leading bits a range's hashes share."""
    if owners <= fan:
        return blocks.groupBy("kind", "range").applyInArrow(_answer, ANSWERS)
    groups, step = -(-owners // fan), fan.bit_length() - 1
    blocks = stage(blocks.withColumn("party", F.pmod(F.xxhash64("owner"), F.lit(groups))), "lm-blocks")
    key = ["kind", "range", "party"]

    def ask(table):
        kind, number, party = (table.column(c)[0].as_py() for c in key)
        _, every, sums, _ = _merged(table)
        return pa.Table.from_batches([_batch(_ranges(kind, number, str(party), every, sums, 64 if kind == WORDS else bits, done, fan), BLOCKS)])

    def hand_out(table, answers):
        if not table.num_rows:
            return pa.Table.from_batches([_batch([], ANSWERS)])
        sizes, _, _, at = _merged(table)
        parts = sorted(zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        return pa.Table.from_batches([_batch(_handed(table, sizes, np.concatenate([unpack_counts(c) for _, c in parts]), at), ANSWERS)])

    found = stage(answered(blocks.groupBy(*key).applyInArrow(ask, BLOCKS), groups, bits, done + step, fan), "lm-party-answers")
    parts = found.where("kind > 0").select("kind", F.expr(f"`range` div {fan}L").alias("range"), F.col("owner").cast("long").alias("party"),
        F.col("range").alias("part"), "counts")
    out = blocks.groupBy(*key).cogroup(parts.groupBy(*key)).applyInArrow(hand_out, ANSWERS)
    return out.unionAll(found.where("kind = 0"))


def _tokens(table: pa.Table, bits: int):
    """Of a chunk with the answers to its questions: docs table, sizes, and per token the counts of its word, context,
    pair, pair before it (0 for a first token) and triple."""
    steady_memory(ARRAYS)
    d = table.to_pydict()
    own = d["kind"].index(0)
    docs, sizes, words, at = _sequence({c: d[c][own] for c in ("docs", "keys", "at")})
    before, first, _, pair_at, _, triple_at = ngram_views(words, at, sizes, bits)
    c1, c2, c3 = (
        np.concatenate([np.zeros(0, np.int64), *(unpack_counts(c) for _, c in sorted((r, c) for k, r, c in zip(d["kind"], d["range"], d["counts"],
            strict=True) if k == kind))]) for kind in (WORDS, PAIRS, TRIPLES)
    )
    pair = c2[pair_at]
    context, triple = np.zeros_like(pair), np.zeros_like(pair)
    context[1:] = pair[:-1]
    context[first] = 0
    triple[~first] = c3[triple_at[~first]]
    return docs, sizes, first, c1[at], c1[before], pair, context, triple


def estimates(cw, cv, cvw, cuv, cuvw, n: int, v: int):
    """Trigram, bigram, word and base estimates; 0 where the context was never seen."""
    ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    return ratio(cuvw, cuv), ratio(cvw, cv), cw / max(1, n), (cw + 1) / (n + v + 1)


def octave(c: np.ndarray, most: int) -> np.ndarray:
    """0 for 0, else 1 + floor(log2 c), at most ``most`` - 1."""
    return np.where(c > 0, np.minimum(most - 1, 1 + np.log2(np.maximum(c, 1)).astype(np.int64)), 0)


def context_bucket(cv: np.ndarray, cuv: np.ndarray) -> np.ndarray:
    """Buckets of seen pairs come after those of single contexts."""
    return np.where(cuv > 0, CONTEXT_BUCKETS + octave(cuv, CONTEXT_BUCKETS), octave(cv, CONTEXT_BUCKETS))


CELLS = "cell long, k long, s3 double, s2 double, s1 double"


def held_out_cells(table: pa.Table, bits: int, n: int, v: int) -> pa.Table:
    """EM's histogram of a chunk's training tokens: (bucket, trigram, bigram and word bin) with counts and summed logs."""
    trimmed()
    docs, sizes, first, cw, cv, cvw, cuv, cuvw = _tokens(table, bits)
    t = np.repeat(~docs.column("held").to_numpy(zero_copy_only=False), sizes)
    cw, cv, cvw = cw[t] - 1, cv[t] - 1, cvw[t] - 1
    cuv, cuvw = (np.where(first[t], 0, c[t] - 1) for c in (cuv, cuvw))
    f3, f2, f1, f0 = estimates(cw, cv, cvw, cuv, cuvw, n - 1, v)
    logs = [np.log2(np.where(f > 0, f, f0) / f0) for f in (f3, f2, f1)]
    bins = [np.where(f > 0, np.clip(np.round(x) + 8, 1, X_BINS - 1), 0).astype(np.int64) for f, x in zip((f3, f2), logs[:2], strict=True)]
    cell = ((context_bucket(cv, cuv) * X_BINS + bins[0]) * X_BINS + bins[1]) * Y_BINS + octave(cw, Y_BINS)
    some, of = np.unique(cell, return_inverse=True)
    sums = [np.bincount(of, weights=x, minlength=len(some)) for x in (None, *logs)]
    return pa.table([pa.array(some, pa.int64()), pa.array(sums[0].astype(np.int64)), *(pa.array(x.astype(np.float64)) for x in sums[1:])],
        names=[x.split()[0] for x in CELLS.split(", ")])


def em(weight: np.ndarray, ratio: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights by expectation-maximisation over tokens of the given weight and estimates relative to the base."""
    w = np.where(ratio.max(0) > 0, 1.0, 0.0)
    w /= w.sum()
    for _ in range(rounds):
        share = w * ratio
        w = (weight[:, None] * share / share.sum(1, keepdims=True)).sum(0) / weight.sum()
    w = np.where(ratio.max(0) > 0, np.maximum(w, [0.0, 0.0, 1e-6, 1e-6]), 0.0)
    return w / w.sum()


def mixture_weights(cells: list) -> np.ndarray:
    """Weights (trigram, bigram, word, base) of every bucket. A bucket without held-out tokens takes those of the one below;
    the first of each kind what is left of them without the estimates it lacks."""
    out = np.zeros((2 * CONTEXT_BUCKETS, 4))
    by: dict = {}
    for r in cells:
        x3, x2, y = r["cell"] // (X_BINS * Y_BINS) % X_BINS, r["cell"] // Y_BINS % X_BINS, r["cell"] % Y_BINS
        of = [2.0 ** (s / r["k"]) if there else 0.0 for s, there in ((r["s3"], x3), (r["s2"], x2), (r["s1"], y))]
        by.setdefault(r["cell"] // (X_BINS * X_BINS * Y_BINS), []).append((r["k"], *of, 1.0))
    last = np.array([0.0, 0.0, 0.0, 1.0])
    for bucket in range(2 * CONTEXT_BUCKETS):
        if bucket in by:
            a = np.array(sorted(by[bucket]))
            last = em(a[:, 0], a[:, 1:])
        out[bucket] = last
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(table: pa.Table, bits: int, weights: np.ndarray, n: int, v: int) -> pa.Table:
    """SCORES of a chunk's documents."""
    trimmed()
    docs, sizes, _, cw, cv, cvw, cuv, cuvw = _tokens(table, bits)
    f = estimates(cw, cv, cvw, cuv, cuvw, n, v)
    w = weights[context_bucket(cv, cuv)]
    logs = np.log10(sum(w[:, i] * f[i] for i in range(4)))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    known, base, score = (np.add.reduceat(x, starts) for x in ((cw > 0).astype(np.int64), np.log10(f[3]), logs))
    columns = [docs.column("doc_id").combine_chunks(), docs.column("held").combine_chunks(), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes),
        n)), pa.array(base), pa.array(score)]
    return pa.table(columns, names=[x.split()[0] for x in SCORES.split(", ")])


def score_lm(docs: DataFrame, held: str = "held_out", doc_id: str = "doc_id", text: str = "text", chunk_tokens: int = CHUNK, fan: int = FAN) -> DataFrame:
    """SCORES of every row of ``docs``, learning from those whose column ``held`` is false. ``fan`` is a power of two."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(held).alias("held_out"))
    chunks = stage(chunked(rows, chunk_tokens), "lm-chunks")
    n_chunks, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    bits, ranges = hash_bits(tokens), min(fan, 1 << max(0, n_chunks - 1).bit_length())
    answers = stage(answered(asked(chunks, bits, ranges), n_chunks, bits, ranges.bit_length() - 1, fan), "lm-answers")
    n, v = (int(x or 0) for x in answers.where("kind = 0").agg(F.sum("total"), F.sum("types")).first())
    none = F.lit(None).cast("binary")
    own = chunks.select(F.lit(0).alias("kind"), "chunk", F.lit(-1).cast("long").alias("range"), "docs", "keys", "at", none.alias("counts"))
    replies = answers.where("kind > 0").select("kind", F.col("owner").alias("chunk"), "range", none.alias("docs"), none.alias("keys"), none.alias("at"),
        "counts")
    whole = own.unionAll(replies).groupBy("chunk")
    weights = np.array([[0.0, 0.0, 0.0, 1.0]] * (2 * CONTEXT_BUCKETS))
    if n:
        cells = whole.applyInArrow(lambda t: held_out_cells(t, bits, n, v), CELLS)
        with shuffles_dropped(spark):  # at most a row per cell
            weights = mixture_weights(cells.groupBy("cell").agg(F.sum("k").alias("k"), *[F.sum(c).alias(c) for c in ("s3", "s2", "s1")]).collect())
    return whole.applyInArrow(lambda t: scored(t, bits, weights, n, v), SCORES)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_lm(docs.withColumn("held_out", held_out(F.col("doc_id"), 7, 2)))
