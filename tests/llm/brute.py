"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, r, n < 50 or 100 * r > 50 * n


def fingerprint(text: str | None) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], budget: int = 2) -> list[int]:
    """Smallest index reachable from each."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def contamination(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    phrases = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[k : k + window])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for m in {len(p) for p in phrases}:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k : k + m])) in phrases:
                    hit |= set(range(k, k + m))
                    names |= phrases[p]
        out.append((d, len(w), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, int]]:
    t, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return sorted(out)


def without_repeats(docs: list[tuple], length: int = 50) -> list[tuple]:
    first: dict[tuple, int] = {}
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in words:
        for k in range(len(w) - length + 1):
            p = tuple(w[k : k + length])
            if d is not None:
                first[p] = min(first.get(p, d), d)
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - length + 1):
            if d is not None and first[tuple(w[k : k + length])] < d:
                gone |= set(range(k, k + length))
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def conversations(rows: list[tuple]) -> dict:
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((-math.inf if turn is None else turn, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said))
    return out


def unigram(docs: list[tuple]) -> list[tuple]:
    tokens = [(d, WORD.findall((t or "").translate(LOWER)) + ["\n"]) for d, t in docs]
    c = Counter(w for d, ws in tokens if crc(d) % 5 != 1 for w in ws)
    n = sum(c.values())
    return [(d, crc(d) % 5 == 1, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in ws)) for d, ws in tokens]


def context_tree(train: list[bytes], depth: int = 2):
    """Probability of a text by a tree written out node by node."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(b: bytes):
        s = b"\0\0" + b + b"\0"
        for k in range(2, len(s)):
            prefix = 1
            for j in range(7, -1, -1):
                bit = s[k] >> j & 1
                yield s[k - 2 : k], prefix, bit
                prefix = prefix * 2 + bit

    for b in train:
        for context, prefix, bit in decisions(b):
            for d in range(depth + 1):
                counts[d, context[2 - d :], prefix][bit] += 1
    children = defaultdict(list)
    for node in counts:
        if node[0]:
            children[node[0] - 1, node[1][1:], node[2]].append(node)
    own = lambda n: math.lgamma(counts[n][0] + 0.5) + math.lgamma(counts[n][1] + 0.5) - math.lgamma(sum(counts[n]) + 1) - math.log(math.pi)
    weighted = {}
    for node in sorted(counts, key=lambda n: -n[0]):
        a = own(node)
        if node[0] < depth:
            b = sum(weighted[k] for k in children[node])
            a = max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)
        weighted[node] = a

    def one(d: int, context: bytes, prefix: int) -> float:
        node = (d, context[2 - d :], prefix)
        if node not in counts:
            return 0.5
        p = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
        if d == depth:
            return p
        share = math.exp(own(node) - math.log(2) - weighted[node])
        return share * p + (1 - share) * one(d + 1, context, prefix)

    return lambda b: sum(math.log10(p if bit else 1 - p) for c, x, bit in decisions(b) for p in [one(0, c, x)])
