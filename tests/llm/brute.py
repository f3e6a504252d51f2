"""The contracts by the plainest means, for small tables held in memory."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{doc_id: least linked doc_id} for {doc_id: fingerprint}."""
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and bin(prints[a] ^ prints[b]).count("1") <= 2:
                    label[a], changed = label[b], True
    return label


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def valid_card(number):
        total = 0
        for i, c in enumerate(reversed(number)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return 16 <= len(number) <= 19 and total % 10 == 0

    return ([("email", *m.span()) for m in EMAIL.finditer(text)]
            + [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
            + [("card", *m.span()) for m in CARD.finditer(text) if valid_card(digits(m))]
            + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15])


def without_repeats(rows, length=100):
    """{doc_id: (bytes, removed, spans, sha256 of the rest)} for (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            string = body[i:i + length]
            if string in seen:
                gone[i:i + length] = b"x" * length
            seen.add(string)
        kept = bytes(c for c, g in zip(body, gone) if not g)
        out[doc_id] = (len(body), sum(g > 0 for g in gone), len(re.findall(b"x+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def bins_of_best_fit(lengths, capacity):
    """Room left by best fit decreasing, found by looking at every bin."""
    left, out = [], {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        rooms = [(room, b) for b, room in enumerate(left) if room >= lengths[item]]
        if rooms:
            least = min(rooms)[0]
            b = max(b for room, b in rooms if room == least)
        else:
            left.append(capacity)
            b = len(left) - 1
        left[b] -= lengths[item]
        out[item] = left[b]
    return sorted(left), out


def five_words(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def first_of_near_copies(rows):
    """Ids that are the least of their component, by comparing every pair."""
    sets = {d: five_words(t) for d, t in rows}
    label = {d: d for d in sets}
    alike = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))]
    changed = True
    while changed:
        changed = False
        for a, b in alike:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {d for d in sets if label[d] == d}
