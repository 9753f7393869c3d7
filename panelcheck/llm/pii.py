"""Personal data by weak supervision.

Labelers (strict shape, gazetteer, context words, surroundings) vote on every
candidate span.  Expectation-maximisation over the corpus-wide counts of vote
patterns estimates how reliable each labeler is, and a logistic span classifier
is trained on the resulting soft labels.  Base spans always stay; a further
candidate becomes a span where the classifier says so.

Only counts of vote patterns reach the driver: at most kinds x 3^labelers x
length classes rows, whatever the corpus.

Defined results: a null text has no spans; repeated rows are rows of their own;
an empty table gives an empty result and a model that adds nothing; extra columns are ignored.
"""

from __future__ import annotations

import ipaddress
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcheck.llm.common import joined, per_text, span_digest, written

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only: a match that starts later in it would also start there.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates beyond the base kinds.
AT_WORDS = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}", re.ASCII | re.IGNORECASE)
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w-])", re.ASCII)
IPV6 = re.compile(r"(?<![\w:])(?:[0-9a-f]{1,4}:){2,7}:?[0-9a-f]{1,4}(?:::?[0-9a-f]{1,4})*(?![\w:])", re.ASCII | re.IGNORECASE)

# Gazetteers and context words: fixed values.
TOP_DOMAINS = frozenset("com net org edu gov int info biz io eu de fr es uk us ch at it nl be se no dk fi pl pt ca au in jp cn br mx".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98 351 352 353 358 420 971 972".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "34", "37", "6011", "65", "35", "36", "38")
CONTEXT = {
    "email": re.compile(r"mail|contact|write|courriel|correo|kontakt", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|from", re.I),
    "card": re.compile(r"card|visa|master|amex|payment|credit|carte|tarjeta|karte", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|t[ée]l|llam|anruf", re.I),
}
WINDOW = 40
THRESHOLD = 0.5
LABELERS = 4
CANDIDATE = "struct<start: int, ord: int, kind: string, end: int, base: boolean, votes: array<int>, size: int>"


def emails(text: str):
    """Leftmost matches of the base pattern.  The local part is the run left of an @, so each @ is looked at once."""
    reach = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > reach and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            reach = m.end()
            yield start, reach


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))


def digits_of(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of the base kinds."""
    found = [(s, 0, "email", e) for s, e in emails(text)] if "@" in text else []
    found += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        found += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def further_spans(text: str, base: list[tuple]) -> list[tuple[int, int, str, int]]:
    """Candidates of looser shape that touch no base span."""
    loose = [(m.start(), 0, "email", m.end()) for m in AT_WORDS.finditer(text)] if re.search(r"[\[(] ?at ?[\])]", text, re.I) else []
    if ":" in text:
        loose += [(m.start(), 1, "ip", m.end()) for m in IPV6.finditer(text)]
    loose += [(m.start(), 3, "phone", m.end()) for m in LOCAL_PHONE.finditer(text)]
    out, k, reach = [], 0, 0
    for s in sorted(loose):
        while k < len(base) and base[k][0] < s[3]:
            reach, k = max(reach, base[k][3]), k + 1
        if reach <= s[0]:
            out.append(s)
            reach = s[3]
    return out


def votes(text: str, start: int, kind: str, end: int, base: bool) -> list[int]:
    """Shape, gazetteer, context and surroundings: 1 for, -1 against, 0 abstains."""
    value = text[start:end]
    if kind == "email":
        known = re.split(r"[.)\]\x20]", value.lower())[-1] in TOP_DOMAINS
    elif kind == "ip":
        known = _public(value)
    elif kind == "card":
        known = digits_of(value).startswith(CARD_PREFIXES)
    else:
        d = digits_of(value)
        known = value.startswith("+") and any(d[:n] in CALLING_CODES for n in (1, 2, 3))
    near = text[max(0, start - WINDOW) : start]
    said = any(p.search(near) for p in [CONTEXT[kind]])
    other = any(p.search(near) for k, p in CONTEXT.items() if k != kind)
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return [1 if base else -1, 1 if known else -1, 1 if said else -1 if other else 0, -1 if glued else 1]


def _public(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).is_global
    except ValueError:
        return False


def candidates(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and all candidates with votes and length class."""
    base = base_spans(text)
    rows = [(*s, True) for s in base] + [(*s, False) for s in further_spans(text, base)]
    return base, [(*r, votes(text, r[0], r[2], r[3], r[4]), min(9, (r[3] - r[0]) // 4)) for r in rows]


def scan_text(text: str | None) -> tuple:
    base, found = candidates(text or "")
    kinds = [s[2] for s in base]
    names = ("start", "ord", "kind", "end", "base", "votes", "size")
    return *(kinds.count(k) for k in KINDS), span_digest(base), [dict(zip(names, r, strict=True)) for r in found]


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = f"n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, found array<{CANDIDATE}>"
    return per_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), ["id"], "body", scan_text, schema)


def pattern_counts(scanned: DataFrame) -> list[tuple]:
    """(kind, base, votes, size, count) over the corpus; their number has a fixed bound."""
    each = scanned.select(F.explode("found").alias("s"))
    keys = [F.col("s.ord").alias("ord"), F.col("s.base").alias("base"), F.col("s.votes").alias("votes"), F.col("s.size").alias("size")]
    rows = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["ord"], r["base"], tuple(r["votes"]), r["size"], r["n"]) for r in rows)


def reliabilities(patterns: list[tuple], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and labelers that may abstain: P(vote | class) by labeler, and P(personal | pattern)."""
    v = np.array([p[2] for p in patterns], dtype=int).reshape(-1, LABELERS)
    n = np.array([p[4] for p in patterns], dtype=float)
    rate = np.empty((2, LABELERS, 3))  # class, labeler, vote + 1
    rate[1], rate[0] = [0.15, 0.15, 0.7], [0.6, 0.3, 0.1]
    prior, post = 0.5, np.zeros(len(n))
    for _ in range(rounds):
        like = [np.prod([rate[c, j, v[:, j] + 1] for j in range(LABELERS)], axis=0) for c in (0, 1)]
        post = prior * like[1] / np.maximum(prior * like[1] + (1 - prior) * like[0], 1e-300)
        prior = float(np.clip((n @ post) / max(n.sum(), 1), 0.01, 0.99))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(LABELERS):
                seen = np.array([w[v[:, j] == x].sum() for x in (-1, 0, 1)]) + 1.0
                rate[c, j] = seen / seen.sum()
    return rate, post


def features(kind: int, vote: tuple | list, size: int) -> np.ndarray:
    x = np.zeros(4 + LABELERS + 2)
    x[kind] = 1
    x[4 : 4 + LABELERS] = vote
    x[4 + LABELERS :] = size / 10, 1
    return x


def train_classifier(patterns: list[tuple], soft: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels, each pattern weighted by its count."""
    if not patterns:
        return np.r_[np.zeros(4 + LABELERS + 1), -10.0]
    x = np.array([features(p[0], p[2], p[3]) for p in patterns])
    n = np.array([p[4] for p in patterns], dtype=float)
    n = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - soft)) + 1e-4 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(scanned: DataFrame) -> list[float]:
    """Weights of the span classifier, from the scanned corpus."""
    patterns = pattern_counts(scanned)
    _, soft = reliabilities(patterns)
    return [round(float(x), 9) for x in train_classifier(patterns, soft)]


def accepted(row: tuple, weights: list[float]) -> bool:
    """Base spans, and candidates that the classifier takes."""
    return row[4] or float(features(row[1], row[5], row[6]) @ np.array(weights)) >= np.log(THRESHOLD / (1 - THRESHOLD))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    scanned = written(scan(docs, id_col, text_col), "pii-scan")
    weights = fit(scanned)

    def final(found):
        import pandas as pd

        def one(rows):
            taken = [tuple(r[k] for k in ("start", "ord", "kind", "end", "base", "votes", "size")) for r in rows]
            return joined([r[:4] for r in taken if accepted(r, weights)])

        return pd.Series([one(rows) for rows in found], dtype=object)

    spans = F.pandas_udf(final, "string")(F.col("found"))
    n_base = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")
    n_all = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ",")))
    return (
        scanned.withColumn("spans", spans)
        .select(F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", (n_all - n_base).cast("bigint").alias("n_added"))
    )


def redacted(text: str | None, weights: list[float]) -> str | None:
    """The text with every accepted span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for row in sorted(r for r in candidates(text)[1] if accepted(r, weights)):
        if row[0] >= at:
            out += [text[at : row[0]], f"<{row[2].upper()}>"]
        at = max(at, row[3])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text."""
    weights = fit(written(scan(docs, id_col, text_col), "pii-scan"))

    def clean(texts):
        import pandas as pd

        return pd.Series([redacted(t, weights) for t in texts], dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))
