"""Filter audit, secret scans and fill-in-the-middle against brute force on odd documents."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from conftest import TESTDATA
from llm.helpers import DOCS, odd_documents

from callgrid.llm import fill_in_middle, filter_audit, secrets

LABELS = "doc_id long, quality int, toxic int"


# filter audit

def audit_rows():
    """Odd documents, copies under larger, equal and null ids, in several parts, and texts that fail each filter alone."""
    plain = " ".join(f"w{i}" for i in range(210))
    rows = [(*r[:3], "s", 0) for r in odd_documents()]
    rows += [(100, plain, "en", "s", 0), (101, plain, "en", "s", 0), (100, plain, "de", "s", 0), (102, plain, None, "s", 0), (103, plain, "", "s", 0)]
    rows += [(None, plain, "en", "s", 0), (104, "a b " * 150, "en", "s", 0), (105, plain.upper(), "en", "s", 0), (106, plain + " #", "en", "s", 0)]
    rows += [(None, "only here without an id", None, "s", 0)] * 2
    labels = [(100, 1, 0), (100, 0, 1), (101, 1, None), (4, None, 1), (106, 1, 1), (None, 1, 1), (999, 1, 1), (105, 0, 0)]
    return rows, labels


def brute_audit(rows, labels):
    smallest, good, toxic = {}, set(), set()
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        return {k for k, v in tests.items() if v}

    docs = [(p or "", fails(i, t or ""), i in good, i in toxic) for i, t, p, *_ in rows]
    want = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = [d[1:] for d in docs if d[0] == part]
            whole = list(alive)
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[0]]
                alive = [d for d in alive if f not in d[0]]
                shapley[f] += len(gone)
                want[part, order, step] = [len(alive), len(gone), sum(f in d[0] for d in whole) - len(gone), sum(d[0] == {f} for d in whole),
                                           sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in want.items()}


def as_table(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_against_brute_force(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", mask string").repartition(3)
    out = filter_audit.audited(filter_audit.document_failures(docs, spark.createDataFrame(labels, LABELS)))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert as_table(out) == brute_audit(rows, labels)


def test_audit_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audited(filter_audit.document_failures(none, labels)).count() == 0
    rows = audit_rows()[0][:6]
    got = as_table(filter_audit.audited(filter_audit.document_failures(spark.createDataFrame(rows, DOCS), labels)))
    assert got == brute_audit(rows, [])


def test_first_failures():
    for mask in range(32):
        for k, order in enumerate(filter_audit.ORDERS):
            steps = [s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
            assert filter_audit.FIRST[mask, k] == min(steps, default=5)
    assert filter_audit.FIRST.shape == (32, 120)


def test_partial_arrays_of_many_parts(spark):
    """More parts than a task holds: its arrays leave in pieces, and sums stay whole."""
    rows = [(f"p{i % 700}", i % 32, i % 4, 1 + i % 3) for i in range(5000)]
    got = as_table(filter_audit.audited(spark.createDataFrame(rows, "part string, mask int, label int, n long").repartition(2)))
    assert len(got) == 700 * 600
    kept, none = Counter(), [r for r in rows if r[1] == 0]
    for p, _, _, n in none:
        kept[p] += n
    assert all(got[f"p{i}", "ABCDE", 5][0] == kept[f"p{i}"] for i in range(700))


# secrets

LIVE, COPIED = "Zq8rT2vXw0Lm4Nb6Yc1K", "Example0Key1Value2Abc"


def secret_rows():
    r = [
        (1, f"x {LIVE} y", "en", "a"), (2, f"é漢 {LIVE}", "en", "a"), (3, f"{COPIED}", "en", "a"), (4, f"({COPIED})", "en", "b"), (5, None, None, None),
        (6, "", "en", "a"), (7, "PassWord = 'abcdefgh1' api-key: zzzzzzzzz apikey:\"12345678\" api_key=1234567", "en", "a"),
        (8, "AKIA" + "B" * 12 + " AKIA" + "B" * 11 + " xAKIAAKIA0000000000", "en", "c"), (9, "a" * 31 + " " + "b0" * 16 + "G" + "f" * 33, "fr", "c"),
        (10, "token=token=abcdefgh secret:token:abcdefgh1 ſecret=abcdefgh", "fr", None), (11, f"token: {LIVE}9", "de", "d"), (None, f"{LIVE}7", None, None),
        (12, "long " * 50000 + f"secret={'q' * 5000}" + " 漢" * 1000 + f" {LIVE}x", "en", "a"), (13, f"{LIVE}5", "x1", "e"),
        (13, f"{LIVE}5", "x1", "e"), (14, "lowercaselettersandnothingelse1234 " + "A1b" * 9, "en", "a"),
    ]
    r += [(20 + i, f"{LIVE}6", f"l{i}", "f") for i in range(5)]  # five repositories of one owner
    return [(i, t, lang, s, None) for i, t, lang, s in r]


def brute_secrets(rows):
    def spans(t):
        found = []
        for kind, pattern, group, least in ((0, r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
                                            (1, "AKIA[A-Z0-9]+", 0, 16), (2, "[0-9a-f]+", 0, 32)):
            found += [(m.start(), kind, m.end(), m[group]) for m in re.finditer(pattern, t) if len(m[group]) >= least]
        base, taken = sorted(found), {i for s, _, e, _ in found for i in range(s, e)}
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+_=-]{20,}", t)
                if not taken & set(range(m.start(), m.end())) and secrets.looks_random(m[0])]
        return base, sorted(base + more)

    held = defaultdict(set)
    for _, t, lang, s, _ in rows:
        for x in spans(t or "")[1]:
            held[x[3]].add((s, lang))
    text = lambda found: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in found)
    live = lambda v: len({s for s, _ in held[v]}) <= 1 and len(held[v]) <= 4
    for i, t, *_ in rows:
        base, every = spans(t or "")
        kinds = [sum(x[1] == k for x in base) for k in range(3)]
        yield (i, *kinds, hashlib.sha256(text(base).encode()).hexdigest(), text([x for x in every if x[1] < 3 or live(x[3])]),
               sum(live(x[3]) for x in every), sum(not live(x[3]) for x in every))


@pytest.mark.parametrize("rows", [secret_rows(), odd_documents(), []], ids=["secrets", "odd", "none"])
def test_secrets_against_brute_force(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", spans string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op12_secrets(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_secrets(rows)))


def test_secrets_on_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = secrets.op12_secrets(spark, TESTDATA).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_secrets(rows)))


def test_verdicts_separate_copies_from_live_values(spark):
    out = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(secret_rows(), DOCS)).collect()}
    assert [x["live"] for x in out[1]] == [True] and [(x["owners"], x["live"]) for x in out[3]] == [(2, False)]
    assert [(x["repositories"], x["live"]) for x in out[20]] == [(5, False)]


def test_opaque_spans_touch_no_other():
    text = f"{LIVE} {LIVE} {LIVE}"
    known = [(0, 0, 30, ""), (5, 1, 6, ""), (41, 2, 42, "")]
    assert [x[:3] for x in secrets.opaque_spans(text, known)] == [(42, 3, 62)]
    assert [x[0] for x in secrets.opaque_spans(text, [])] == [0, 21, 42]


# fill in the middle

def brute_middle(doc_id, text, changed=90, suffix_first=20, seed=1):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= changed:
        return len(u), "plain", text, None, None
    if h4 % 100 < suffix_first:
        return len(u), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(u), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def middle_rows():
    pieces = ["\x1e", "\x1f", "\x1e0", "\x1e1", "\x1f0", "a", "Zb", "<", ">", "<P", "S>", "é", "漢", "😀", "\n", "\r\n", "0", "1", "$0", "\\", "ſ", "\x00"]
    r = np.random.default_rng(13)
    rows = [(i, "".join(r.choice(pieces, r.integers(0, 30)))) for i in range(600)]
    rows += [(700, "<P>"), (701, "a<S>b"), (702, "<M>"), (703, "<p>"), (704, None), (704, None), (None, "no id, but some words"), (705, "word " * 100000),
             (706, "x" * 200000), (707, "漢" * 50000), (708, "<<P"), (709, "M>")]
    return rows + [r[:2] for r in odd_documents()]


@pytest.mark.parametrize("settings", [{}, {"changed": 100, "suffix_first": 100}, {"changed": 100, "suffix_first": 0, "seed": 7}, {"changed": 0}])
def test_middle_against_brute_force(spark, settings):
    rows = middle_rows()
    docs = spark.createDataFrame([(i, t, "clash", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, output string, at long")
    out = fill_in_middle.fill_in_middle(docs, **settings)
    assert out.columns == ["doc_id", "text", "at", "n", "form", "output", "prefix_chars", "middle_chars"]
    out = out.withColumn("again", fill_in_middle.restored(out["output"], out["form"])).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["doc_id"], r["text"]) == rows[r["at"]]
        assert (r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == brute_middle(r["doc_id"], r["text"], **settings)
        assert r["again"] == (r["text"] or "")


def test_middle_of_nothing_and_its_plan(spark):
    none = spark.createDataFrame([], DOCS)
    out = fill_in_middle.fill_in_middle(none)
    assert out.count() == 0
    plan = fill_in_middle.op13_fill_in_middle(spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
