"""What the corpus operators must find, written the plain way."""

import hashlib
import math
import re
import unicodedata
import zlib

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_rules(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii_base(text):
    out = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def contamination(docs, items):
    """docs: (doc_id, text); items: (item_id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text, n):
    w = words(ascii_lower(text or ""))
    if not w:
        return frozenset()
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard_components(docs, n=4, num=85, den=100):
    """(doc_id, set size, component) by all pairs that share a shingle."""
    sets = [(d, shingles(t, n)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for own in by.values():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if min(len(a), len(b)) * den >= num * max(len(a), len(b)):
                        both = len(a & b)
                        if den * both >= num * (len(a) + len(b) - both):
                            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [(d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets)]


def near(a, b):
    """Within one edit."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def line_edits(docs, min_chars=20):
    lines = [(d, i, x.rstrip(" ")) for d, t in docs for i, x in enumerate((t or "").split("\n")) if t is not None and len(x.rstrip(" ")) >= min_chars]
    out = []
    for d, i, x in lines:
        first = min((e, j) for e, j, y in lines if abs(len(x) - len(y)) <= 1 and near(x, y))
        if first < (d, i):
            out.append((d, i, *first))
    return out


def passage_blocks(text, least_words=25, line_words=20):
    """(first word, last word) of what is hashed, by the rules one by one."""
    w = words(text.lower())
    rank = [hashlib.md5(x.encode()).hexdigest()[:8] for x in w]
    ends = [i + 1 for i, x in enumerate(rank) if x == min(rank[max(0, i - 3) : i + 4])]
    lines, n = [], 0
    for line in text.split("\n"):
        k = len(words(line))
        if k:
            lines.append((n, n + k))
        n += k
    out = {x for x in lines if x[1] - x[0] >= line_words}
    for i in {0} | {i for i in ends if i < n} | {a for a, b in lines if b - a < line_words}:
        last = [e for e in ends if e >= i + least_words]
        if n - i >= least_words:
            out.add((i, last[0] if last else n))
    return sorted(out)


def repeated_spans(docs, least_words=25, line_words=20):
    """docs with different ids, none null.  The spans that go."""
    first, out = {}, []
    for d, text in sorted(docs, key=lambda r: r[0]):
        text = text or ""
        w = words(text.lower())
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        held = []
        for a, b in passage_blocks(text, least_words, line_words):
            place = first.setdefault(" ".join(w[a:b]), (d, spans[a][0]))
            if place != (d, spans[a][0]):
                if held and a <= held[-1][1]:
                    held[-1][1] = max(b, held[-1][1])
                else:
                    held.append([a, b, place])
        out += [(d, spans[a][0], spans[b - 1][1], b - a, *place) for a, b, place in held]
    return out


def repeated_windows(docs, width=50):
    """doc_id to the words that lie in a window found earlier."""
    first, out = {}, {}
    for d, text in sorted(docs, key=lambda r: r[0]):
        w = words((text or "").lower())
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), (d, i)) != (d, i):
                out.setdefault(d, set()).update(range(i, i + width))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def placement(docs, shards, record_bytes=16):
    """(doc_id, size, CRC-32, shard, slot): records in the order of their text's
    MD5 and id on one line of bytes, cut into equal stretches."""
    rows = []
    for d, t in docs:
        raw = (t or "").encode()
        rows.append((int(hashlib.md5(raw).hexdigest()[:15], 16), -(2**63) if d is None else d, len(raw) + record_bytes, d, zlib.crc32(raw)))
    rows.sort(key=lambda r: r[:3])
    total, start, slots, out = sum(r[2] for r in rows), 0, {}, []
    for _, _, size, d, crc in rows:
        shard = min(shards - 1, (2 * start + size) * shards // (2 * total))
        out.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        start += size
    return out


def backoff(text, languages, words, grams):
    """(language, score).  words and grams: key to a list of log frequencies."""
    found = [w for w in re.split(r"[\W\d_]+", "".join(c if unicodedata.category(c)[0] in "LM" or not c.isnumeric() else " " for c in (text or "").lower())) if w]
    if not found:
        return "und", 0.0
    total = [0.0] * len(languages)
    for w in found:
        parts = []
        if w in words:
            parts.append(words[w])
        else:
            rest = f"^{w}$"
            while rest:
                fits = [n for n in range(1, len(rest) + 1) if rest[:n] in grams]
                if fits:
                    parts.append(grams[rest[: fits[-1]]])
                rest = rest[fits[-1] :] if fits else rest[1:]
        for p in parts:
            total = [a + b for a, b in zip(total, p, strict=True)]
    best = max(range(len(languages)), key=lambda i: (total[i], -i))
    return languages[best], 1 / sum(math.exp(max(-700, x - total[best])) for x in total)
