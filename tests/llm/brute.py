"""Plain versions of the operators for small inputs."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import xxhash


def edit_at_most_one(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[p + 1 :] == short[p:]


def dedup_lines(rows, min_chars=20):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (text, n_lines, n_removed)}."""
    seen, equal, out = [], set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc] = None, 0, 0
            continue
        lines, kept = text.split("\n"), []
        for line in lines:
            if not re.search(r"[^\x20\x09-\x0D]", line):  # blank
                kept.append(line)
                continue
            long = len(line) >= min_chars
            if line not in equal and not (long and any(edit_at_most_one(line, s) for s in seen)):
                kept.append(line)
            equal.add(line)
            if long:
                seen.append(line)
        out[doc] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def simhash_components(rows, bits=3):
    """(doc_id, text) -> {doc_id: (fingerprint hex, component)}."""
    prints = {d: simhash(t) for d, t in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def warc_rows(rows, min_bytes=0):
    """(page_id, html) with distinct ids -> the set of rows that reading back gives."""
    first = {}
    for page, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", page)
    out = set()
    for page, html in rows:
        data = (html or "").encode()
        revisit = first[html or ""] != page and len(data) >= min_bytes
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.add((page, len(data), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return out


def quality_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination(rows, items, size=10):
    """(doc_id, text), (item_id, text) -> {doc_id: (n_words, n_hit, sorted item ids as strings)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = _words(text)
        if w:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(item)
    out = {}
    for doc, text in rows:
        w, hit, found = _words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        out[doc] = len(w), len(hit), sorted(str(i) for i in found if i is not None)
    return out


def repeated_bytes(rows, size):
    """(doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept bytes)}."""
    texts = {d: (t or "").encode() for d, t in rows}
    times = Counter(b[i : i + size] for b in texts.values() for i in range(len(b) - size + 1))
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if times[b[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)
    return out
