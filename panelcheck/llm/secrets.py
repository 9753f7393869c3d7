"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for credentials (base kinds with fixed patterns) and for
further random-looking tokens.  The hash of each candidate value is counted
over the corpus by distinct repositories and owners: a value seen with many
owners or in many repositories is a copied example, any other looks live.
Random-looking tokens become spans only when they look live; base spans always stay.

Defined results: a null text has no spans; a null owner or repository counts as
one value of its own; repeated rows are rows of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcheck.llm.common import per_text, span_digest, spans_text, written

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 8, 16, 32, 20
# Whole runs only, entered at their first character: the same matches as all runs filtered by length.
HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}")
RANDOM = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RANDOM},}}")
MIN_BITS = 3.5  # bits a character, of a random-looking token
EXAMPLE_OWNERS = 3  # a value with so many owners is a copied example
EXAMPLE_REPOS = 10  # a value in so many repositories is one too, whoever owns them

SPAN = "struct<start: int, ord: int, kind: string, end: int, hash: bigint>"


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def bits_per_char(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, int, str]]:
    """(start, rank of the kind, kind, end, value) of the base kinds."""
    found = [(m.start(), 0, "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, "access", m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple]) -> list[tuple[int, int, str, int, str]]:
    """Long tokens of mixed characters outside the base spans."""
    found, k, reach = [], 0, 0
    for m in RANDOM.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach, k = max(reach, base[k][3]), k + 1
        value = m[0]
        mixed = re.search("[0-9]", value) and re.search("[A-Z]", value) and re.search("[a-z]", value)
        if reach <= m.start() and mixed and bits_per_char(value) >= MIN_BITS:
            found.append((m.start(), 3, "token", m.end(), value))
    return found


def scan_text(text: str | None) -> tuple:
    text = text or ""
    base = base_spans(text)
    row = lambda s: (s[0], s[1], s[2], s[3], value_hash(s[4]))
    kinds = [s[2] for s in base]
    as_rows = [dict(zip(("start", "ord", "kind", "end", "hash"), row(s), strict=True)) for s in [*base, *random_spans(text, base)]]
    return *(kinds.count(k) for k in KINDS[:3]), span_digest([s[:4] for s in base]), as_rows


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Rows with ``row``, id, repo, owner, base counts, digest and all candidates."""
    source = docs.select(
        F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("body")
    )
    schema = f"n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<{SPAN}>"
    return per_text(source, ["id", "repo", "owner"], "body", scan_text, schema).withColumn("row", F.monotonically_increasing_id())


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_repos and n_owners of every candidate value, over the whole corpus."""
    each = scanned.select(F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.explode("found").alias("s"))
    return each.groupBy(F.col("s.hash").alias("hash")).agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source",
    example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_assign, n_access, n_hex, base_sha256, all (spans with their ownership), and how many
    values look live or like copied examples (n_live, n_example; the latter with tokens that are no span)."""
    scanned = written(scan(docs, id_col, text_col, repo_col, owner_col), "secret-scan")
    each = scanned.select("row", F.explode("found").alias("s"))
    known = each.join(ownership(scanned), F.col("s.hash") == F.col("hash"))
    live = (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)
    span = F.struct("s.start", "s.ord", "s.kind", "s.end", "s.hash", "n_repos", "n_owners", live.alias("live"))
    per_row = known.groupBy("row").agg(F.collect_list(span).alias("spans"))
    stays = lambda s: (s["ord"] < 3) | s["live"]
    merged = scanned.join(per_row.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    every = F.array_sort(F.coalesce("spans", F.array()))
    counted = lambda live: F.size(F.filter("every", lambda s: s["live"] == live)).cast("bigint")
    return merged.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", every.alias("every")).select(
        id_col, "n_assign", "n_access", "n_hex", "base_sha256",
        F.filter("every", stays).alias("all"), counted(True).alias("n_live"), counted(False).alias("n_example"),
    )


def digest_rows(found: DataFrame) -> DataFrame:
    """The columns of the query: spans as one text."""
    return found.withColumn("spans", spans_text(F.col("all"))).drop("all")
