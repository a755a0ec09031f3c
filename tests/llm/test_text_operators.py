"""Packing, mixing, line dedup, quality, scoring, fingerprints and near-dedup against brute force on odd documents."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from conftest import TESTDATA
from llm.helpers import BLANK, DOCS, lower, odd_documents, words

from callgrid.llm import fingerprint, line_dedup, lm_score, mixing, near_dedup, packing, quality


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_documents()
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]


# packing

def test_packing_is_exact_and_gapless(spark, odd):
    from tokenizers import Tokenizer

    rows, df = odd
    got = packing.pack_documents(df.select("doc_id", "text")).collect()
    t = Tokenizer.from_file(packing.default_vocabulary())
    want = collections.Counter()
    for doc, text in texts(rows):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[doc, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_of_nothing(none):
    assert packing.pack_documents(none.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "middle", "few", "one", "small"])
def test_plan_holds_every_piece_and_is_tight(kind):
    r = np.random.default_rng(1)
    lengths = {"uniform": r.integers(1, 4097, 5000), "middle": r.integers(1000, 2200, 5000), "few": r.choice([1500, 1300, 1290, 3000, 700], 5000),
        "one": np.full(1000, 1365), "small": r.integers(1, 40, 5000)}[kind]
    h = np.bincount(lengths, minlength=4097)
    held, n = np.zeros(4097, int), 0
    for used, times in packing.plan(h):
        assert sum(used) <= 4096
        n += times
        for x in used:
            held[x] += times
    assert (held == h).all()
    gaps, best = [], 0  # best-fit decreasing
    import bisect

    for x in sorted(lengths.tolist(), reverse=True):
        i = bisect.bisect_left(gaps, x)
        rest = gaps.pop(i) - x if i < len(gaps) else 4096 - x
        best += i == len(gaps) and rest == 4096 - x
        bisect.insort(gaps, rest)
    assert n <= 1.04 * len(gaps)


def test_knapsack_against_all_multisets():
    import itertools

    sizes, values, most = np.array([3, 5, 7]), np.array([4.0, 7.0, 9.9]), np.array([9, 2, 9])
    times = packing.price(values, sizes, most, 20)
    best = max(((np.dot(c, values), c) for c in itertools.product(range(8), range(3), range(4)) if np.dot(c, sizes) <= 20), key=lambda x: x[0])[0]
    assert np.dot(times, sizes) <= 20 and abs(np.dot(times, values) - best) < 1e-9


# mixing

def mixed(df, **how):
    rows = mixing.sized(df, "text", "source", ["doc_id"])
    return mixing.mixed(rows, mixing.mix_plan(rows, **how)).select("row.*", "size", "source_size", "target", "draws")


@pytest.mark.parametrize("block_words", [7, mixing.BLOCK_WORDS])
def test_mixing_quotas_and_limits(spark, odd, block_words):
    rows, df = odd
    out = mixed(df, block_words=block_words).collect()
    assert len(out) == len(rows)
    size = {k: sum(len(words(t)) for _, t, _, s, _ in rows if s == k) for k in {r[3] for r in rows}}
    order = sorted((k for k in size if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:  # reshare the excess until none is above its limit
        left = total - sum(target.values())
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        over = {k for k in free if share[k] > 3 * size[k]}
        if not over:
            target |= share
            break
        target |= {k: 3 * size[k] for k in over}
        free -= over
    for k in order:
        own = [r for r in out if r["source"] == k]
        assert all(abs(r["target"] - target[k]) < 1e-6 and r["source_size"] == size[k] for r in own)
        assert abs(sum(d["words"] for r in own for d in r["draws"]) - target[k]) <= 1
    assert all(r["size"] == len(words(r["text"])) and sum(d["words"] for d in r["draws"]) <= 3 * r["size"] for r in out)
    assert all(0 <= d["shard"] < mixing.LEAST_SHARDS for r in out for d in r["draws"])


def test_mixing_reruns_agree(odd):
    _, df = odd
    a, b = (sorted(map(str, mixed(df, block_words=7).select("doc_id", "draws").collect())) for _ in range(2))
    assert a == b


def test_shards_come_whole_and_shuffled(spark):
    """Each shard is one partition whose rows are in the order of their place, and every source is spread over the shards."""
    docs = spark.createDataFrame([(i, f"w{i} " * 20, "en", f"s{i % 3}", 0) for i in range(900)], DOCS)
    rows = mixing.sized(docs, "text", "source", ["doc_id"])
    plan = mixing.mix_plan(rows, shards=4, block_words=100)
    draws = {}
    for r in mixing.mixed(rows, plan).select("row.doc_id", "draws").collect():
        for d in r["draws"]:
            draws.setdefault(r["doc_id"], []).append((d["shard"], d["place"]))
    parts = mixing.drawn_rows(rows, plan).rdd.mapPartitions(lambda it: [[r["doc_id"] for r in it]]).collect()
    assert len(parts) == 4 and sum(map(len, parts)) == sum(map(len, draws.values()))
    for shard, ids in enumerate(parts):
        assert ids == [i for _, i in sorted((place, i) for i, many in draws.items() for s, place in many if s == shard)]
        assert {i % 3 for i in ids} == {0, 1, 2} and ids != sorted(ids)


def test_splitting_tree_is_exact_and_random(spark):
    q = spark.createDataFrame([("a", 1000), ("b", 0), ("c", 24)], "key string, quota long")
    got = mixing.split_quotas(q, 8).collect()
    for key, n in (("a", 1000), ("b", 0), ("c", 24)):
        assert sum(r["quota"] for r in got if r["key"] == key) == n
    per = collections.Counter()
    for r in got:
        per[r["shard"]] += r["quota"]
    assert set(per.values()) == {128} and len({r["quota"] for r in got if r["key"] == "c"}) > 1


def test_mixing_of_nothing(none, spark):
    assert mixed(none).count() == 0
    empty = spark.createDataFrame([(1, None, None, "a", None), (2, "", None, "b", 0)], DOCS)
    assert all(r["target"] == 0 and r["draws"] == [] for r in mixed(empty).collect())


def test_mixing_takes_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", i, i, i, i) for i in range(9)],
        "doc_id long, text string, source string, key long, size long, block long, draws long")
    rows = mixing.sized(docs, "text", "source", ["doc_id"])
    out = mixing.drawn_rows(rows, mixing.mix_plan(rows))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


# line dedup

def test_line_dedup_against_brute_force(odd):
    rows, df = odd
    got = sorted((str(r["doc_id"]), r["__lines"], len(r["__kept"]), r["t"]) for r in line_dedup.dedup_lines(df).withColumn("t",
        line_dedup.kept_text(line_dedup.F.col("text"), line_dedup.F.col("__kept"))).collect())
    holders = collections.defaultdict(set)
    for doc, text in texts(rows):
        for line in text.split("\n"):
            k = lower(line.strip(BLANK))
            if len(k) >= 20:
                holders[k].add(doc)
    first = lambda s: max(s, key=lambda x: -math.inf if x is None else x)
    want = []
    for doc, text in texts(rows):
        lines = text.split("\n")
        kept = [x for x in lines if not (len(k := lower(x.strip(BLANK))) >= 20 and len(holders[k]) >= 3 and first(holders[k]) != doc)]
        want.append((str(doc), len(lines), len(kept), "\n".join(kept)))
    assert got == sorted(want)


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for batch in range(3):
        rows = [(10 - batch, i % 5 + batch, 0) for i in range(10)]
        runs.add(spark.createDataFrame(rows, "id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 1]
    got = {r["h1"]: (r["n_docs"], r["holder"]) for r in runs.index().collect()}
    assert got == {0: (1, 10), 1: (2, 10), 2: (3, 10), 3: (3, 10), 4: (3, 10), 5: (2, 9), 6: (1, 8)}
    runs.drop()


def test_runs_are_met_where_they_lie(spark):
    """Runs are bucketed like a batch's own counts, so merging deals nothing besides the batch itself."""
    runs, batch = line_dedup.LineRuns(spark, fanout=9), spark.range(10).selectExpr("id", "id AS h1", "0L AS h2")
    for _ in range(3):
        runs.add(batch)
    plain, met = (x._jdf.queryExecution().executedPlan().toString() for x in (runs.counted(batch), runs.met(runs.counted(batch))))
    assert met.count("Join") == 3 and met.count(" Exchange") == plain.count(" Exchange")
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (7, 2), (9, 3)])
def test_batches_meet_compacted_runs(spark, batches, fanout):
    """Lines shared over all distances, null ids, ids on several rows: any number of batches and levels gives the same."""
    r = np.random.default_rng(12)
    lines = [f"line number {i} of more than twenty characters" for i in range(40)]
    rows = [(None if i % 17 == 0 else int(i // 2 if i % 5 == 0 else i), "\n".join(lines[k] for k in r.integers(0, 40, r.integers(0, 6))), "en", "s", 0)
        for i in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    out = line_dedup.dedup_lines(df, batches=batches, fanout=fanout)
    got = sorted((str(r["doc_id"]), r["t"]) for r in out.withColumn("t", line_dedup.kept_text(line_dedup.F.col("text"), line_dedup.F.col("__kept"))).collect())
    holders = collections.defaultdict(set)
    for doc, text in texts(rows):
        for line in text.split("\n"):
            holders[line].add(doc)
    last = {k: max(v, key=lambda x: -1 if x is None else x) for k, v in holders.items() if len(v) >= 3 and len(k) >= 20}
    assert got == sorted((str(doc), "\n".join(x for x in text.split("\n") if last.get(x, doc) == doc)) for doc, text in texts(rows))


def test_line_dedup_takes_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"a line of more than twenty characters\n{i}", 5, 6, 7) for i in range(4)],
        "doc_id long, text string, lost long, id long, row long")
    out = line_dedup.dedup_lines(df, lines="n", kept="k")
    assert out.columns == [*df.columns, "n", "k"] and sorted((r["doc_id"], r["k"], r["id"]) for r in out.collect()) == [(0, [1], 6), (1, [1], 6), (2, [1],
        6), (3, [0, 1], 6)]


def test_line_dedup_of_nothing(none):
    assert line_dedup.dedup_lines(none).count() == 0


# quality

def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.op5_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.9
    assert docs.count() == quality.op5_quality(spark, "/root/testdata/sf0.01").count()


def test_quality_without_labels(spark, odd):
    rows, df = odd
    model = quality.fit_quality(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_quality(df, model).collect()} == {0.5}
    one = quality.fit_quality(df, spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, None), (None, 0)], "doc_id long, quality int"))
    assert one == {"constant": 1.0}


def test_quality_takes_odd_texts(spark, odd):
    rows, df = odd
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 15)], "doc_id long, quality int")
    out = quality.score_quality(df.withColumn("score", df["doc_id"]), quality.fit_quality(df, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)


def test_quality_score_is_the_calibrated_size_difference(spark, odd):
    """Scores from the model's parts, step by step: windows, sizes under both dictionaries, the logistic curve."""
    import zstandard

    rows, df = odd
    docs = spark.createDataFrame([(i, ("good plain prose number " if i % 2 else "x9#! buy now $$$ ") * (i + 3) + str(i), None, None, None)
        for i in range(60)], DOCS)
    model = quality.fit_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))

    def sizes(text, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary)
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        data = text.encode()
        return sum(len(c.compress(data[i : i + 1024])) for i in range(0, max(1, len(data)), 1024))

    got = collections.Counter((r["text"], round(r["score"], 9)) for r in quality.score_quality(df, model).collect())
    want = collections.Counter()
    for _, text, *_ in rows:
        t = text or ""
        gain = 20 * (sizes(t, model["bad"]) - sizes(t, model["good"])) / max(1, len(t.encode()))
        size = math.log1p(len(t.encode()))
        z = sum(w * x for w, x in zip(model["w"], (1, gain, size, gain * size), strict=True))
        want[text, round(1 / (1 + math.exp(-max(-30, min(30, z)))), 9)] += 1
    assert got == want


# scoring

def direct_scores(rows, held):
    """Deleted interpolation token by token: counts in dictionaries, EM over all training tokens."""
    texts_of = [[*words(t), None] for _, t, *_ in rows]
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for t, out in zip(texts_of, held, strict=True):
        if not out:
            for i, w in enumerate(t):
                v = t[i - 1] if i else None
                c1[w] += 1
                c2[v, w] += 1
                if i:
                    c3[t[i - 2] if i > 1 else None, v, w] += 1
    n, types = sum(c1.values()), len(c1)

    def of(t, i, less):
        w, v = t[i], t[i - 1] if i else None
        u = t[i - 2] if i > 1 else None
        cw, cv, cvw = c1[w] - less, c1[v] - less, c2[v, w] - less
        cuv, cuvw = (c2[u, v] - less, c3[u, v, w] - less) if i else (0, 0)
        f = (cuvw / cuv if cuv > 0 else 0.0, cvw / cv if cv > 0 else 0.0, cw / (n - less), (cw + 1) / (n - less + types + 1))
        return ("pair", cuv.bit_length()) if cuv > 0 else ("word", cv.bit_length()), f

    by = collections.defaultdict(list)
    for t, out in zip(texts_of, held, strict=True):
        if not out:
            for i in range(len(t)):
                b, f = of(t, i, 1)
                by[b].append(f)
    weights, last = {}, np.array([0, 0, 0, 1.0])
    for kind in ("word", "pair"):
        for k in range(lm_score.CONTEXT_BUCKETS):
            if (kind, k) in by:
                f = np.array(by[kind, k])
                w = (f.max(0) > 0) / (f.max(0) > 0).sum()
                for _ in range(lm_score.EM_ROUNDS):
                    share = w * f / f[:, 3:]
                    w = (share / share.sum(1, keepdims=True)).mean(0)
                last = w
            weights[kind, k] = last
    return [sum(math.log10(max(1e-300, float(np.dot(weights[b], f)))) for b, f in (of(t, i, 0) for i in range(len(t)))) for t in texts_of]


def test_lm_score_against_direct_interpolation(spark):
    """Binned EM against EM over single tokens, on texts that repeat words, pairs, triples and whole texts."""
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(120)]
    p = 1 / np.arange(1, 121)
    rows = [(i, " ".join(r.choice(vocabulary, r.integers(1, 80), p=p / p.sum())), None, None, None) for i in range(150)]
    rows += [(150 + i, rows[i][1], None, None, None) for i in range(20)] + [(200, "never seen words", None, None, None), (201, None, None, None, None)]
    held = [zlib.crc32(str(row[0]).encode()) % 7 == 2 for row in rows]
    docs = spark.createDataFrame(rows, DOCS).withColumn("held_out", quality.held_out(lm_score.F.col("doc_id"), 7, 2))
    got = {x["doc_id"]: x for x in lm_score.score_lm(docs, chunk_tokens=500).collect()}
    want = direct_scores(rows, held)
    for row, w in zip(rows, want, strict=True):
        x = got[row[0]]
        assert abs(x["score"] - w) < 0.01 * x["n_tokens"] + 1e-6, (row[0], x["score"], w)
    again = [got[150 + i]["score"] / got[150 + i]["n_tokens"] for i in range(20)]
    once = [got[i]["score"] / got[i]["n_tokens"] for i in range(20, 150)]
    assert np.mean(again) > np.mean(once)


def test_lm_counts_by_parties_are_the_same(spark):
    """More chunks than the fan: groups of chunks are merged, and ask in turn, over three levels."""
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").limit(60).withColumn("held_out", quality.held_out(lm_score.F.col("doc_id"), 7, 2))
    a, b = ({r["doc_id"]: r for r in lm_score.score_lm(docs, chunk_tokens=n, fan=fan).collect()} for n, fan in ((3000, 2), (1 << 20, 256)))
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k]["n_tokens"], a[k]["n_known"], a[k]["train_tokens"]) == (b[k]["n_tokens"], b[k]["n_known"], b[k]["train_tokens"])
        assert abs(a[k]["score"] - b[k]["score"]) < 1e-7 * b[k]["n_tokens"] and abs(a[k]["base_score"] - b[k]["base_score"]) < 1e-7


@pytest.mark.parametrize("chunk", [50, 1_000_000])
def test_lm_against_brute_force(spark, odd, chunk):
    rows, df = odd
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 3 == 1 and r[0] is not None for r in rows}
    got = collections.defaultdict(list)
    for r in lm_score.score_lm(df.withColumn("held_out", quality.held_out(df["doc_id"], 3, 1)), chunk_tokens=chunk, fan=4).collect():
        got[r["doc_id"]].append(r)
    token = {i: [[*words(r[1]), None] for r in rows if r[0] == i] for i in held}
    c = collections.Counter(w for i in token if not held[i] for t in token[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, many in token.items():
        for t, r in zip(many, got[i], strict=True):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, held[i])
            assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-8
            assert math.isfinite(r["score"])


def test_lm_beats_its_base_and_chunks_do_not_matter(spark):
    out = lm_score.op7_lm_score(spark, TESTDATA).where("held_out").collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").withColumn("held_out", quality.held_out(lm_score.F.col("doc_id"), 7, 2))
    a, b = ({r["doc_id"]: r["score"] for r in lm_score.score_lm(docs, chunk_tokens=n).collect()} for n in (5000, 1 << 20))
    assert all(abs(a[k] - b[k]) < 1e-8 for k in a)


def test_lm_without_training(spark, odd, none):
    _, df = odd
    out = lm_score.score_lm(df.withColumn("held_out", lm_score.F.lit(True))).collect()
    assert all(r["train_tokens"] == 0 and abs(r["score"] - r["base_score"]) < 1e-12 for r in out)
    assert lm_score.score_lm(none.withColumn("held_out", lm_score.F.lit(True))).count() == 0


# fingerprints

def test_fingerprints_meet_the_next_document(spark, odd):
    rows, df = odd
    got = fingerprint.fingerprints_with_next(df).collect()
    assert len(got) == len(rows)
    ordered = sorted((r for r in rows if r[0] != 15), key=lambda r: -math.inf if r[0] is None else r[0], reverse=True)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 15}
    for a, b in zip(ordered[:-1], ordered[1:], strict=True):
        x, y = a[1] or "", b[1] or ""
        text = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert by[a[0]]["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest() and by[a[0]]["n_chars"] == len(x)
        assert by[a[0]]["edited_fingerprint"] == fingerprint.fingerprint(text.encode()) and 0 <= by[a[0]]["near_next"] <= 1
    last = by[None]
    assert last["edited_sha256"] == hashlib.sha256(fingerprint.edited_text(ordered[-1][1], "tie").encode()).hexdigest()


def test_fingerprint_properties(none):
    r = np.random.default_rng(2)
    a = bytes(r.integers(97, 123, 3000, dtype=np.uint8))
    b = bytes(r.integers(97, 123, 3000, dtype=np.uint8))
    f = fingerprint.fingerprint
    assert fingerprint.likeness(f(a), f(a)) == 1 and fingerprint.likeness(f(b""), f(b"")) == 1
    assert fingerprint.likeness(f(a), f(a[:2900])) > 0.8 > fingerprint.likeness(f(a), f(b)) >= 0
    assert fingerprint.fingerprints_with_next(none).count() == 0


def test_fingerprint_against_single_triplets():
    """Digests from triplets counted one by one, and likeness from the codes read out of the hex."""
    r = np.random.default_rng(5)
    texts = [b"", b"a", b"ab", b"abc", b"abcd", b"aaaaaaaaaaaa", "é漢字 and more".encode(), bytes(r.integers(0, 256, 997, dtype=np.uint8)),
        b"plain words in a row " * 40]
    codes = {}
    for data in texts:
        counts = [0] * 256
        for at in range(len(data)):
            for kind, (i, j) in enumerate(((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))):
                if at + j < len(data):
                    t = fingerprint.TABLES[kind]
                    counts[t[0][data[at]] ^ t[1][data[at + i]] ^ t[2][data[at + j]]] += 1
        q = [sorted(counts)[k] for k in (63, 127, 191)]
        codes[data] = [sum(c > x for x in q) for c in counts]
        bits = "".join(f"{c:02b}" for c in codes[data])
        size = min(255, round(12 * math.log2(1 + len(data)))) if data else 0
        head = f"{size:02x}" + "".join(f"{min(15, x * 15 // q[2]) if q[2] else 0:x}" for x in q[:2])
        assert fingerprint.fingerprint(data) == head + "".join(f"{int(bits[k : k + 4], 2):x}" for k in range(0, 512, 4))
    for a in texts:
        for b in texts:
            x, y = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
            body = sum((0, 1, 2, 6)[abs(m - n)] for m, n in zip(codes[a], codes[b], strict=True))
            far = body + abs(int(x[:2], 16) - int(y[:2], 16)) / 4 + (abs(int(x[2], 16) - int(y[2], 16)) + abs(int(x[3], 16) - int(y[3], 16))) / 2
            assert abs(fingerprint.likeness(x, y) - (1 - min(far, 1.6 * 256) / (1.6 * 256))) < 1e-12


def test_quality_leaves_out_only_the_texts_that_do_not_fit(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} text of document {i} " * 20, None, None, None) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, quality int")
    most = sum(len(t) for _, t, *_ in rows)
    first = spark.range(40).orderBy(quality.F.xxhash64(quality.F.lit(quality.SEED), "id")).first()["id"]
    rows[first] = (first, "long " * most, None, None, None)
    assert "constant" not in quality.fit_quality(spark.createDataFrame(rows, DOCS), labels, fit_bytes=most)


# near-dedup

def brute_components(rows):
    sets = {}
    for doc, text in texts(rows):
        w = words(text)
        sets[doc] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)), key=lambda v: math.inf if v is None else v)
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_dedup_against_brute_force(odd):
    rows, df = odd
    want = brute_components(rows)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_dedup_of_a_group_of_edited_copies(spark):
    """Copies of one text, each with its own edits: most resemble only the original."""
    r = np.random.default_rng(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base), None, None, None)]
    for i in range(1, 120):
        w = list(base)
        for at in r.choice(300, r.integers(1, 12), replace=False):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w), None, None, None))
    want = brute_components(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, (_, c) in want.items()}


def test_near_dedup_keeps_a_link_below_higher_estimates(spark):
    """0 and 1 are linked; 2 is linked to neither, though its signature agrees more with both."""
    r = np.random.default_rng(161)
    rows = []
    for k in range(3):
        w = [f"w{i}" for i in range(400)]
        for at in r.choice(400, 6, replace=False):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w), None, None, None))
    want = brute_components(rows)
    assert [c for _, c in want.values()] == [0, 0, 2]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, (_, c) in want.items()}


def test_near_dedup_of_triples_at_the_threshold(spark):
    """150 triples of texts with 5 or 6 of 400 words changed in each, so that their likeness lies around 0.75."""
    r = np.random.default_rng(75)
    rows = []
    for triple in range(150):
        for k in range(3):
            w = [f"t{triple}_{i}" for i in range(400)]
            for at in r.choice(400, 5 + int(r.integers(2)), replace=False):
                w[at] = f"x{triple}_{k}_{at}"
            rows.append((3 * triple + k, " ".join(w), None, None, None))
    want = {d: c for d, (_, c) in brute_components(rows).items()}
    assert 150 < len(set(want.values())) < 300
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_dedup_counts_rows_by_their_text(spark):
    """Rows that share an id lie where their texts belong; a row without id takes part; the stage keeps one row of a group."""
    import corpus_pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = a.replace("a30", "other")
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (None, near, "en", "s", 0), (None, b, "en", "s", 0), (7, b, "en", "s", 0), (7, b, "en", "s", 0),
        (None, None, "en", "s", 0), (None, None, "en", "s", 0), (None, "alone without id but with words", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == sorted([("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "1", False), ("7", "1", False), ("7", "1", False), ("None",
        "None", True), ("None", "None", True), ("None", "None", True)])
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert kept == sorted([("1", a), ("1", b), ("None", "None"), ("None", "None"), ("None", "alone without id but with words")])


def test_near_dedup_of_a_dense_family(spark):
    """Documents at about 0.71 to each other, each with one partner at about 0.78: no row stands out in their regions."""
    r = np.random.default_rng(7)
    rows = []
    for pair in range(300):
        both = r.choice(240, 6, replace=False)
        for k in (2 * pair, 2 * pair + 1):
            w = [f"w{i}" for i in range(1200)]
            for at in both:
                w[5 * at] = f"y{pair}_{at}"
            for at in r.choice(np.setdiff1d(np.arange(240), both), 15, replace=False):
                w[5 * at] = f"x{k}_{at}"
            rows.append((k, " ".join(w), None, None, None))
    want = {d: c for d, (_, c) in brute_components(rows).items()}
    assert len(set(want.values())) > 280  # a few pairs are linked to another
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_dedup_of_nothing(none):
    assert near_dedup.near_duplicates(none).count() == 0
