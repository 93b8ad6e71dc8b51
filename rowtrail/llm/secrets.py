"""Secret scans: pattern candidates in each text, judged by how many repositories and owners hold the same value.

A value that many owners carry is a copied example; a value that one owner alone carries and that looks random is
treated as a live credential.  Only hashes of the values are compared and kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, small_batches, written

#: The base kinds, in the order in which ties are listed.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    "access": (r"AKIA[A-Z0-9]+", re.A, 0, 16),
    "hex": (r"[0-9a-f]+", re.A, 0, 32),
}
#: Kinds that count only where the corpus shows one owner alone: (pattern, group, least length).
OWNED = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]{16,}-----END [A-Z ]*PRIVATE KEY-----", 0, 16),
    "bearer": (r"\b(?:ghp|gho|ghs|glpat|xox[abprs]|sk|pk|rk|AIza)[-_A-Za-z0-9]{20,}", 0, 24),
    "opaque": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])", 0, 24),
}
KINDS = [*BASE, *OWNED]
_BASE = {k: (re.compile(p, f), g, n) for k, (p, f, g, n) in BASE.items()}
_OWNED = {k: (re.compile(p, re.A), g, n) for k, (p, g, n) in OWNED.items()}
#: A cheap test for the whole column: texts without a hit hold no candidate of any kind.
SCREEN = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|-----BEGIN|ghp|gho|ghs|glpat|xox|sk|pk|rk|AIza|[A-Za-z0-9+/_-]{24}"
SCHEMA = (
    "doc_id long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<string>,"
    " found array<struct<kind:string,start:int,end:int,value:binary>>"
)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def scan_text(text: str, least_entropy: float = 3.5) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of one text, base kinds first: leftmost non-overlapping matches of each kind, short ones dropped.

    Positions are code points, end exclusive.  Owned kinds that overlap a base span, or look too regular, are left out.
    """
    found = []
    for kind, (pattern, group, least) in _BASE.items():
        found += [(kind, m.start(), m.end(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    for kind, (pattern, group, least) in _OWNED.items():
        taken = joined((s, e) for _, s, e, _ in found)
        starts = [s for s, _ in taken]
        for m in pattern.finditer(text):
            s, e = m.span()
            at = bisect_right(starts, s)
            free = (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or starts[at] >= e)
            if free and e - s >= least and entropy(m[group]) >= least_entropy:
                found.append((kind, s, e, m[group]))
    return found


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    order = {k: i for i, k in enumerate(KINDS)}
    schema = None
    for batch in batches:
        hits = pc.fill_null(pc.match_substring_regex(batch.column("text"), SCREEN), False).to_pylist()
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "found")}
        for i, hit in enumerate(hits):
            found = scan_text(batch.column("text")[i].as_py()) if hit else []
            found.sort(key=lambda x: (x[1], order[x[0]]))
            base = [f"{k}:{s}:{e}" for k, s, e, _ in found if k in BASE]
            kinds = Counter(k for k, *_ in found)
            out["n_assign"].append(kinds["assign"])
            out["n_access"].append(kinds["access"])
            out["n_hex"].append(kinds["hex"])
            out["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest() if base else none)
            out["base"].append(base)
            out["found"].append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16]} for k, s, e, v in found])
        if schema is None:
            part = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())])
            schema = pa.schema(
                [("doc_id", pa.int64()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(pa.string())), ("found", pa.list_(part))]
            )
        arrays = [batch.column("doc_id"), batch.column("owner")] + [pa.array(out[f.name], f.type) for f in list(schema)[2:]]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def find_candidates(docs: DataFrame, owner_column: str = "source") -> DataFrame:
    """One row per document: base counts, the base digest, the base spans, and all candidates with value hashes."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner_column).cast("string").alias("owner"), F.col("text").cast("string").alias("text")
    ).mapInArrow(_scan, SCHEMA)


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value hash: occurrences, distinct repositories (documents) and distinct owners, over the whole corpus.

    Counted in three steps, each with a partial aggregate before its shuffle, so a value that a third of all rows
    carry reaches one task only as a few counts.  A null owner counts as one owner of its own.
    """
    per_repo = candidates.groupBy("value", "owner", "doc_id").agg(F.count("*").alias("n"))
    per_owner = per_repo.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return per_owner.groupBy("value").agg(F.sum("n").alias("occurrences"), F.sum("repos").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(docs: DataFrame, owner_column: str = "source", shared_owners: int = 3, shared_repositories: int = 10) -> DataFrame:
    """Secrets of every text with the corpus's verdict on each value.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (base spans, and owned kinds whose value is live;
    ``kind:start:end`` joined by commas), n_live (values of one owner in fewer than ``shared_repositories`` repositories)
    and n_copied (values of at least ``shared_owners`` owners or ``shared_repositories`` repositories, be they one owner's).  Null or empty texts have no spans; repeated rows are scanned each and share the counts
    of their doc_id; extra columns are ignored; an empty table gives an empty result.
    """
    # a row number of the scan keeps repeated doc_ids apart
    rows = written(find_candidates(docs, owner_column).withColumn("row", F.monotonically_increasing_id()), "secrets")
    found = rows.where(F.size("found") > 0).select("row", "doc_id", "owner", F.explode("found").alias("f")).select("row", "doc_id", "owner", "f.*")
    judged = hot_join(found, written(ownership(found), "secrets"), ["value"], "occurrences")
    live = (F.col("owners") == 1) & (F.col("repositories") < shared_repositories)
    copied = (F.col("owners") >= shared_owners) | (F.col("repositories") >= shared_repositories)
    extra = F.col("kind").isin(*OWNED) & live
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    span = F.struct("start", order[F.col("kind")].alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(extra | F.col("kind").isin(*BASE), span)).alias("kept"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum(copied.cast("long")).alias("n_copied"),
    )
    return rows.join(by_row, "row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(F.array_join(F.transform(F.array_sort("kept"), lambda x: x["span"]), ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document's source is its owner, the document its repository."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
