"""Credentials in files, judged by who else holds them.

Every text is searched for credential-like strings. Their hashes are counted over the whole corpus
by distinct crates (repositories) and cohorts (owners of crates): a string that many owners hold is
a copied example, one that stays with an owner and looks random may be live. Spans of the base
detectors are always reported; those of the further detectors only where the counts speak for a
live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm.storage import kept, shuffled
from evimill.llm.texts import per_text

# What counts as a credential. Name, pattern, least length of the secret; the secret
# is the last group, or else the whole match, and ends where the match does.
BASE = [
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        12,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 16),
]
FURTHER = [
    ("forge", re.compile(r"\bgh[oprsu]_[A-Za-z0-9]{20,}"), 24),
    ("chat", re.compile(r"\bxox[abeprs]-[A-Za-z0-9-]{10,}"), 15),
    ("signed", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 30),
    ("url", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,80}:([^\s:/@]{8,80})(?=@)"), 8),
    ("private", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}"), 40),
    ("opaque", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}={0,2}"), 32),
]
KINDS = [name for name, _, _ in (*BASE, *FURTHER)]
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|redacted|xxxx|your[_-]|\.\.\.", re.IGNORECASE)

#: Owners up to which a credential is theirs, however often they repeat it.
FEW_OWNERS = 2

FOUND = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "candidates array<struct<kind: int, start: int, end: int, value: int, secret: string, looks_live: boolean>>"
)


def looks_live(secret: str, least_bits: float = 2.5) -> bool:
    """Random enough for a real credential: entropy per character, and no word of a placeholder."""
    counts = Counter(secret).values()
    bits = -sum(n / len(secret) * math.log2(n / len(secret)) for n in counts)
    return bits >= least_bits and not PLACEHOLDER.search(secret)


def candidates(text: str) -> list[dict]:
    """All credential-like strings of a text by start, then kind; places in code points, end exclusive."""
    found = []
    for kind, (_, pattern, least) in enumerate((*BASE, *FURTHER)):
        for match in pattern.finditer(text):
            value = match.start(match.lastindex or 0)
            secret = match.group(match.lastindex or 0)
            if len(secret) >= least:
                found.append(
                    {
                        "kind": kind,
                        "start": match.start(),
                        "end": match.end(),
                        "value": value,
                        "secret": hashlib.blake2b(secret.encode(), digest_size=16).hexdigest(),
                        "looks_live": looks_live(secret),
                    }
                )
    return sorted(found, key=lambda x: (x["start"], x["kind"]))


def _detected(text: str) -> dict:
    found = candidates(text)
    base = [x for x in found if x["kind"] < len(BASE)]
    listed = ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in base)
    counts = Counter(x["kind"] for x in base)
    return {
        "n_assign": counts[0],
        "n_access": counts[1],
        "n_hex": counts[2],
        "base_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "candidates": found,
    }


def detected(content: Column) -> Column:
    """struct of the counts and digest of the base spans, and all candidates; null counts as empty."""
    return per_text(_detected, f"struct<{FOUND}>", content)


def ownership(found: DataFrame) -> DataFrame:
    """secret, owners, repositories: over how many cohorts, and crates of them, each secret is spread.

    ``found``: crate, cohort, secret. Null is a crate or cohort like any other. The distinct of all
    three keeps a secret that everybody copies from meeting in one task before it is reduced.
    """
    return (
        found.select("secret", "cohort", "crate")
        .distinct()
        .groupBy("secret", "cohort")
        .agg(F.count("*").alias("crates"))
        .groupBy("secret")
        .agg(F.count("*").alias("owners"), F.sum("crates").alias("repositories"))
    )


def judged(found: DataFrame, max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """Candidates, one row each, with owners, repositories and ``live``.

    Live: it looks random and no more than ``max_owners`` cohorts hold it. One or two owners may
    hold it in any number of their crates; where more owners are allowed, a string of more than two
    is live in ``max_repositories`` crates at most. ``found``: row, crate, cohort, candidates.
    """
    each = found.select("row", "crate", "cohort", F.inline("candidates"))
    spread = ownership(each).repartition(F.xxhash64("secret"))
    spare = (F.col("owners") <= FEW_OWNERS) | (F.col("repositories") <= max_repositories)
    live = F.col("looks_live") & (F.col("owners") <= max_owners) & spare
    return each.join(shuffled(spread), "secret").withColumn("live", live)


def scan_secrets(files: DataFrame, max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """One row per file: file_id, n_assign, n_access, n_hex, base_sha256, spans, live_spans, n_live.

    ``files``: file_id, crate, cohort, content; other columns are not read. ``spans`` lists
    kind:start:end of the base spans and of those further ones that are live, by start and kind;
    ``live_spans`` the live ones of either sort. A null text is empty; repeated rows count once in
    the ownership, as they name the same crate, and are reported each.
    """
    found = kept(
        files.select(
            F.monotonically_increasing_id().alias("row"), "file_id", "crate", "cohort",
            detected(F.col("content")).alias("found"),
        ).select("row", "file_id", "crate", "cohort", "found.*")
    )
    name = F.element_at(F.array(*(F.lit(kind) for kind in KINDS)), F.col("x.kind") + 1)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: x["label"]), ",")

    spans = (
        judged(found.where(F.size("candidates") > 0), max_owners, max_repositories)
        .where((F.col("kind") < len(BASE)) | F.col("live"))
        .select("row", F.struct("start", "kind", "end", "live").alias("x"))
        .withColumn("label", F.concat_ws(":", name, "x.start", "x.end"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("x.start", "x.kind", "x.end", "x.live", "label"))).alias("all"))
        .select("row", "all", F.filter("all", lambda x: x["live"]).alias("alive"))
        .select(
            "row", listed(F.col("all")).alias("spans"), listed(F.col("alive")).alias("live_spans"),
            F.size("alive").cast("bigint").alias("n_live"),
        )
    )
    return found.join(shuffled(spans), "row", "left").select(
        "file_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("live_spans", F.lit("")).alias("live_spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )


def masked(content: Column, places: Column, mask: str = "[credential]") -> Column:
    """``content`` with each (start, end) of ``places`` replaced; places that overlap become one."""

    @F.arrow_udf(returnType="string")
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for whole, cuts in zip(text, spans, strict=True):
            whole, at, parts = whole.as_py(), 0, []
            for cut in sorted((x["start"], x["end"]) for x in cuts.as_py() or ()):
                if cut[0] >= at:
                    parts += [whole[at : cut[0]], mask]
                at = max(at, cut[1])
            out.append(whole if not parts else "".join([*parts, whole[at:]]))
        return pa.array(out, pa.string())

    return run(content, places)


def without_live_secrets(files: DataFrame, max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """``files`` with all their columns, live secrets in ``content`` masked; no row is dropped.

    Texts without candidates pass through; only the others are shuffled. Columns that begin with
    an underscore and ``secret`` are used inside and must not be there.
    """
    marked = files.withColumn("_secret_found", detected(F.col("content"))["candidates"])
    own = files.columns
    clean = marked.where(F.size("_secret_found") == 0).select(*own)
    suspect = kept(marked.where(F.size("_secret_found") > 0).withColumn("_secret_row", F.monotonically_increasing_id()))
    found = suspect.select(
        F.col("_secret_row").alias("row"), "crate", "cohort", F.col("_secret_found").alias("candidates")
    )
    live = (
        judged(found, max_owners, max_repositories)
        .where("live")
        .groupBy(F.col("row").alias("_secret_row"))
        .agg(F.collect_list(F.struct(F.col("value").alias("start"), "end")).alias("_secret_live"))
    )
    repaired = (
        suspect.join(shuffled(live), "_secret_row", "left")
        .withColumn("content", masked(F.col("content"), F.col("_secret_live")))
        .select(*own)
    )
    return clean.unionByName(repaired)
