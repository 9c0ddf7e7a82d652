"""Plain single-machine versions of the operators, written from the contract alone."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def substring_dedup(rows, width=20):
    """rows: (doc_id, text), ids may be shared; a list of (doc_id, n_words, n_removed, kept) in the order of rows."""
    first, out = {}, []
    each = [(doc, WORD.findall(text or "")) for doc, text in rows]
    for doc, words in each:
        for s in range(len(words) - width + 1):
            k = tuple(words[s : s + width])
            first[k] = min(first.get(k, (doc, s)), (doc, s))
    for doc, words in each:
        gone = {i for s in range(len(words) - width + 1) if first[tuple(words[s : s + width])] < (doc, s) for i in range(s, s + width)}
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def decontaminate(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(UPPER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else []:
            wins[tuple(w[i : i + n])].add(str(item))
    sizes = {len(k) for k in wins}
    out = {}
    for doc, text in rows:
        w = word.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def jaccard(rows, num=85, den=100):
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        sets[doc] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def secret_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def pii_base(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    by = defaultdict(list)
    for i in range(len(w) - 2):
        by[tuple(w[i : i + 3])].append(i)
    again = {j for v in by.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n
