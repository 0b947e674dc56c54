"""Plain-Python versions of what the operators must return."""

import base64
import collections
import hashlib
import math
import re
import string
import zlib

import numpy as np
import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fingerprint(text):
    words = BLANK_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, most):
    """Least index reachable over values that differ in at most `most` bits."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    array = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in (np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= most) + i + 1).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def rule_statistics(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts, covered = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(k, k + 5))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if BLANK_WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def fertility(text, model, bands, spread):
    """(tokens, characters per token, fallback share, entropy share, whether the band of the text's language holds), token by token; bands: {lang: Band}."""
    words = BLANK_WORD.findall(text or "")
    pieces = [k for w in words for k in model.encode(w)]
    n = len(pieces)
    if not n:
        return 0, 0.0, 0.0, 0.0, {}
    shares = [c / n for c in collections.Counter(pieces).values()]
    entropy = -sum(p * math.log2(p) for p in shares) / math.log2(spread * n / (spread + n)) if n > 1 else 1.0
    chars, fallback, slack = sum(map(len, words)) / n, sum(map(model.is_byte, pieces)) / n, 0.3 / math.sqrt(n)
    inside = {k: b.least_chars * (1 - slack) <= chars <= b.most_chars * (1 + slack) and fallback <= b.most_fallback + slack and entropy >= b.least_entropy - slack for k, b in bands.items()}
    return n, chars, fallback, entropy, inside


def line_dedup(docs):
    """docs [(doc_id, text)] -> [(doc_id, new text, lines, dropped)]; documents are told apart by id, rows without one count for none."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, text in docs:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 20 and i is not None:
                holders[k].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for i, text in items:
        words = PLAIN_WORD.findall((text or "").translate(LOWER))
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[k : k + n])].add(i)
    sizes, out = {len(w) for w in windows}, []
    for i, text in docs:
        words, hit, met = PLAIN_WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    met |= found
        out.append((i, len(words), len(hit), sorted(map(str, met - {None})), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def licenses(text, rules, base):
    words = PLAIN_WORD.findall((text or "").translate(LOWER))
    padded, starts, labels = " " + " ".join(words) + " ", [], set()
    for phrase, label in base:
        parts = phrase.split()
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                starts.append(k)
                labels.add(label)
    found = set()
    for r in rules:
        if f" {r.keyword} " in padded:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", padded):
                found.add((padded[: m.start()].count(" ") - 1, padded[: m.end()].count(" "), r.priority, r.label))
    rank = lambda d: (d[0], -d[1], -d[2], d[3])
    kept = {d for d in found if not any(o != d and o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and rank(o) < rank(d) for o in found)}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), sorted(labels | {d[3] for d in kept})


def base32_sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def spark_hash(text):
    """xxhash64() of a string column; null is the seed."""
    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
