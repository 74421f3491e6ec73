"""Personal data: labelers vote on candidate spans, their reliabilities are estimated, and a span classifier is trained.

Candidates are the matches of four base patterns, also those that fail their check (digits, parts, Luhn), and spellings
beyond them: written-out addresses, numbers without a country code, grouped cards, long IP addresses.  Four labelers
(check, gazetteer, context words, span borders) vote yes, no or nothing.  Counts of (kind, votes, features) over the
whole table are all that leaves the tasks; the number of such patterns is bounded by their coding.
Expectation-maximisation on them gives the reliability of each labeler per kind and a probability per pattern, with the
base spans known to be true; a logistic classifier of votes and features is trained on these probabilities.

Base spans always stay.  A candidate that the classifier accepts is added unless it overlaps a span that comes before.

Defined results: null and empty texts have no spans; rows without doc_id and repeated rows are treated like others; with
no candidates nothing is trained; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import landed
from .text import map_texts

# Kinds in the order of the digests.
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_OTHER = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,63})+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]?[0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
)
_AT = re.compile(r"[(\[](?:at|AT)[)\]]")

GAZETTEER = {
    "email": {"com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "it", "nl", "at", "ch", "us", "ca"},
    "phone": {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91"},
}
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|login|address|client|adresse|servidor)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|pay|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|téléphone|teléfono)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|ticket|build|sha|md5|serial|release)\b")
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has its own @: go left from it to the start of the local part, not beyond the match before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _passes(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in span.split(".")))
    if kind == "card":
        d = _digits(span)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(span)) <= 15
    return True


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of every match of the base patterns."""
    out = [("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(kind, m.start(), m.end(), _passes(kind, m[0])) for m in pattern.finditer(text)]
    return out


def _others(text: str) -> Iterator[tuple[str, int, int]]:
    digits = _DIGIT.search(text)
    for kind, pattern in _OTHER:
        if _AT.search(text) if kind == "email" else digits:
            yield from ((kind, m.start(), m.end()) for m in pattern.finditer(text))


# votes: 0 none, 1 yes, 2 no
def _votes(text: str, kind: str, a: int, b: int, checked: int) -> tuple[int, int, int, int]:
    span = text[a:b]
    known = 0
    if kind == "email":
        known = 1 if re.split(r"[.)\] ]", span)[-1].lower() in GAZETTEER["email"] else 0
    elif kind == "phone" and span[0] == "+":
        d = _digits(span)
        known = 1 if any(d.startswith(c) for c in GAZETTEER["phone"]) else 2
    elif kind == "card":
        d = _digits(span)
        known = 1 if len(d) >= 13 and (d[0] == "4" or "51" <= d[:2] <= "55" or d[:2] in ("34", "37", "35", "62", "65") or d[:4] == "6011" or "2221" <= d[:4] <= "2720") else 2
    elif kind == "ip" and "." in span:
        known = 2 if span.split(".")[0].lstrip("0") in ("", "127", "255") else 1
    near = text[max(0, a - REACH) : a]
    context = 1 if CUES[kind].search(near) else 2 if AGAINST.search(near) else 0
    before, after = text[a - 1 : a], text[b : b + 1]
    edges = 2 if (before.isalnum() and kind != "email") or after.isalnum() or after in ("@", "_") and after else 1
    return checked, known, context, edges


def _features(text: str, kind: str, a: int, b: int) -> int:
    span = text[a:b]
    d = len(_digits(span))
    flags = (a == 0 or text[a - 1] in " \t\n", b == len(text) or text[b] in " \t\n.,;:!?)", any(c in span for c in " -()"), d >= 8, d >= 16, b - a > 24)
    return sum(1 << k for k, f in enumerate(flags) if f)


FEATURES = 6


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, bool]]]:
    """Base spans (kind, start, end), and all candidates (kind, start, end, pattern, base)."""
    found = matches(text)
    base = [(KINDS.index(k), a, b) for k, a, b, ok in found if ok]
    every = [(k, a, b, 1, True) for k, a, b, ok in found if ok]
    every += [(k, a, b, int(k == "card" or text[a] == "+"), False) for k, a, b in _others(text) if k != "card" or luhn(_digits(text[a:b]))]
    every += [(k, a, b, 2, False) for k, a, b, ok in found if not ok and (k != "card" or len(_digits(text[a:b])) >= 12)]
    out, taken = [], [(a, b) for _, a, b in base]
    for k, a, b, checked, ok in every:
        if not ok:
            if any(a < y and x < b for x, y in taken):
                continue
            taken.append((a, b))
        pattern = KINDS.index(k)
        for v in _votes(text, k, a, b, checked):
            pattern = pattern * 3 + v
        out.append((KINDS.index(k), a, b, pattern << FEATURES | _features(text, k, a, b), ok))
    return sorted(base), sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pattern", T.IntegerType()), T.StructField("base", T.BooleanType())])
FIELDS = T.StructType([T.StructField("_counts", T.ArrayType(T.LongType())), T.StructField("_sha", T.StringType()), T.StructField("_spans", T.ArrayType(SPAN))])
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("base", pa.bool_())]))


def _columns(texts: pa.Array) -> list[pa.Array]:
    counts, shas, spans = [], [], []
    for text in texts.to_pylist():
        base, every = candidates(text)
        counts.append([sum(k == i for k, _, _ in base) for i in range(len(KINDS))])
        shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
        spans.append([dict(zip(("kind", "start", "end", "pattern", "base"), x)) for x in every])
    return [pa.array(counts, pa.list_(pa.int64())), pa.array(shas, pa.string()), pa.array(spans, _ARROW)]


def decode(pattern: int) -> tuple[int, list[int], list[int]]:
    """(kind, votes, features) of a pattern number."""
    features = [pattern >> k & 1 for k in range(FEATURES)]
    rest, votes = pattern >> FEATURES, []
    for _ in range(4):
        rest, v = divmod(rest, 3)
        votes.append(v)
    return rest, votes[::-1], features


def estimate(votes: np.ndarray, weight: np.ndarray, known: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability that a pattern is personal data; ``known`` patterns are.  Each labeler has a rate of each vote per class."""
    p = np.where(known, 1.0, np.clip((votes == 1).sum(1) - 1.5 * (votes == 2).sum(1), -2, 2) / 5 + 0.5)
    for _ in range(rounds):
        share = np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99)
        odds = np.full(len(p), np.log(share / (1 - share)))
        for j in range(votes.shape[1]):
            for v in range(3):
                at = votes[:, j] == v
                yes = ((weight * p)[at].sum() + 1) / ((weight * p).sum() + 3)
                no = ((weight * (1 - p))[at].sum() + 1) / ((weight * (1 - p)).sum() + 3)
                odds[at] += np.log(yes / no)
        new = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def classifier(x: np.ndarray, p: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - q)) - ridge * w
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def accepted(counts: list[tuple[int, bool, int]], threshold: float = 0.9) -> list[int]:
    """Patterns that the trained classifier accepts, from (pattern, base, number of spans)."""
    if not counts:
        return []
    decoded = [decode(p) for p, _, _ in counts]
    kind, votes, feats = (np.array([d[i] for d in decoded]) for i in range(3))
    known, weight = np.array([b for _, b, _ in counts]), np.array([n for _, _, n in counts], float)
    p = np.zeros(len(counts))
    for k in np.unique(kind):
        p[kind == k] = estimate(votes[kind == k], weight[kind == k], known[kind == k])
    x = np.hstack([np.ones((len(p), 1)), votes == 1, votes == 2, kind[:, None] == np.arange(len(KINDS)), feats]).astype(float)
    w = classifier(x, p, weight)
    score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return sorted({counts[i][0] for i in range(len(counts)) if not known[i] and score[i] >= threshold})


def labelled(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``_counts`` and ``_sha`` of the base spans, and ``_spans``: those of the base and those added."""
    d = landed(map_texts(docs, _columns, FIELDS, keep), "pii")
    seen = d.select(F.explode("_spans").alias("s")).groupBy("s.pattern", "s.base").agg(F.count("*").alias("n"))
    # at most 4 kinds x 81 votes x 64 features x 2 rows
    good = accepted([tuple(r) for r in seen.orderBy("pattern", "base").collect()])
    yes = F.array(*[F.lit(p) for p in good]).cast("array<int>")
    spans = F.filter("_spans", lambda s: s["base"] | F.array_contains(yes, s["pattern"]))
    return d.withColumn("_spans", F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))


def found(docs: DataFrame) -> DataFrame:
    d = labelled(docs, ["doc_id"])
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform("_spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return d.select("doc_id", *[F.get("_counts", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.col("_sha").alias("base_sha256"), F.array_join(text, ",").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with each span replaced by its kind in brackets; ``n_chars`` follows where there is one."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    d = labelled(docs.select(row.alias("row"), "text"), ["row"])
    text = F.col("row.text")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # spans by place; an overlapping one gives no second tag, its rest is cut with the first
    ordered = F.sort_array(F.transform("_spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(
        F.when(s["a"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["a"] - acc["at"]), F.get(tags, s["k"]))).otherwise(acc["out"]).alias("out"),
        F.greatest(s["b"], acc["at"]).alias("at"),
    )
    new = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    new = F.when(F.size("_spans") > 0, new).otherwise(text)
    out = d.select("row", new.alias("new"), (F.size("_spans") > 0).alias("changed"))
    values = {"text": F.col("new")} | ({"n_chars": F.when(F.col("changed"), F.length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[values.get(c, F.col("row").getField(c)).alias(c) for c in names])
