"""Secret scans with corpus-wide ownership frequency.

A task finds candidates in whole texts: the three kinds of credentials by their patterns, and runs that look random
(``opaque``). Their values are hashed, and the hashes counted by distinct owners and repositories over the corpus. What
many owners hold is a copied example; what one owner holds, in few repositories, looks like a live credential. The
verdict joins the candidates again, which adds the opaque spans that look live; the patterns' own spans always stay.

The text is read once. What is shuffled are hashes of candidates, never texts or values. The ownership of a hash is
aggregated from distinct (hash, owner, repository) rows, so a value that a third of all documents copy arrives as a few
rows a task; the candidates and the ownership are staged, so that Spark can split their join where a hash is hot.

Defined results: null text is empty text; null owners and repositories count as one of their own. Repeated rows are
scanned as often as they stand, and count once for ownership. Spans are code points, the end exclusive. A table without
candidates keeps all its documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.runtime import by_value, slices, stage

by_value(__name__)

KINDS = ("assign", "access", "hex", "opaque")
#: Letters of the name in either case, ASCII only. Matches whose value is too short are dropped, not shortened.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # of a maximal run either all of it or nothing is a match
OPAQUE = re.compile(r"[A-Za-z0-9+_=-]{20,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Bits a character that random-looking runs hold at least; words and numbers in a row hold fewer.
LEAST_BITS = 3.5
#: A value that more owners, or more repositories of its owner, hold is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 1, 4


def bits(value: str) -> float:
    """Entropy of the characters of a value, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Capitals, small letters and two digits at least, evenly spread."""
    kinds = any("A" <= c <= "Z" for c in value) and any("a" <= c <= "z" for c in value) and sum("0" <= c <= "9" for c in value) >= 2
    return kinds and bits(value) >= LEAST_BITS


def pattern_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the three patterns, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text)]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(x for x in found if len(x[3]) >= LEAST[KINDS[x[1]]])


def opaque_spans(text: str, known: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking runs that touch none of the ``known`` spans, which stand in order of their starts."""
    covered: list[list[int]] = []  # disjoint stretches of the known spans
    for start, _, end, _ in known:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(end, covered[-1][1])
        else:
            covered.append([start, end])
    found, at = [], 0
    for m in OPAQUE.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if not (at < len(covered) and covered[at][0] < m.end()) and looks_random(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.binary())])
SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start: long, kind: int, end: long, hash: binary>>"


def _scan(batches):
    """The first columns stay; the last is the text."""
    for b in slices(batches):
        counts, digests, found = [], [], []
        for text in b.column(b.num_columns - 1).to_pylist():
            own = pattern_spans(text or "")
            counts.append([sum(x[1] == k for x in own) for k in range(3)])
            digests.append(hashlib.sha256(spans_text(own).encode()).hexdigest())
            spans = sorted(own + opaque_spans(text or "", own))
            found.append([{"start": s, "kind": k, "end": e, "hash": hashlib.blake2b(v.encode(), digest_size=16).digest()} for s, k, e, v in spans])
        made = [*(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(digests), pa.array(found, pa.list_(SPAN))]
        if b.num_rows:
            names = [*b.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "found"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=names)


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each hash among rows (hash, owner, repository)."""
    pairs = found.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return pairs.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None,
                 most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """For each row: doc_id, the counts and digest of the patterns' spans, and ``spans``, an array in order of (start, kind
    number, end, owners, repositories, live), of all candidates. By default ``source`` owns a document, and what it has in
    one ``lang`` is a repository."""
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    key = F.xxhash64(F.lit("repository"), F.to_json(F.struct(repository.alias("r"))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), key.alias("repository"), F.col(text).alias("text"))
    scanned = stage(rows.mapInArrow(_scan, f"row long, doc_id long, owner string, repository long, {SCANNED}"), "secrets-scanned")
    own = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    found = scanned.select("row", *own, "owner", "repository", F.explode("found").alias("span")).withColumn("hash", F.col("span.hash"))
    owned = stage(ownership(found), "secrets-ownership")
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    span = F.struct("span.start", "span.kind", "span.end", "owners", "repositories", live.alias("live"))
    judged = found.join(owned, "hash").groupBy("row", *own).agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("row")
    kind = judged.schema["spans"].dataType
    return judged.unionByName(scanned.where(F.size("found") == 0).select(*own, F.array().cast(kind).alias("spans")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])
    said = F.filter("spans", lambda x: (x["kind"] < 3) | x["live"])
    count = lambda rule: F.size(F.filter("spans", rule)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.concat_ws(",", F.transform(said, text)).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_copied"),
    )
