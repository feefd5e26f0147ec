"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return (text or "").encode("utf-8", "replace").lower().decode()


def near_components(rows, percent=75, words=5):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        w = [x for x in re.split("[ \t-\r]+", lower(text)) if x]
        sets[doc_id] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = defaultdict(int)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[max(a, b), min(a, b)] += 1
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check_packing(rows, pieces, encode, window=4096):
    """Every id lies in one piece; sequences are gapless. Returns the share of padding."""
    docs = {d: [*encode(t), 2] for d, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == docs.keys()
    for d, ids in docs.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            part = b"".join(i.to_bytes(4, "little") for i in ids[at:at + p["length"]])
            assert p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids)
    padding = total = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        total += at
    return padding / max(1, total + padding)


def repeat_words(text):
    """Base statistics of a text: words, their characters, symbols, repeated lines, words in repeated windows of eight."""
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i:i + 8])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(BLANK):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def secrets(text):
    """Base spans (kind, start, end)."""
    text = text or ""
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licence_places(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if x]
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    hits = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), sorted(hits)


def ascii_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if w]


def contaminated(docs, items, window=10):
    """(words, which are hit, names of the items with occurring windows) of each text."""
    windows = defaultdict(set)
    for name, text in items:
        w = ascii_words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i:i + size])].add(name)
    sizes = {len(x) for x in windows}
    out = []
    for text in docs:
        w, hit, names = ascii_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    names |= windows[tuple(w[i:i + size])]
        out.append((w, hit, sorted(str(n) for n in names if n is not None)))
    return out


def damage(rows):
    """conv_id -> its rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) for c, rs in out.items()}


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of one conversation's rows, by a forward search over all edits."""
    turns = [t for t, _, _ in rows if t is not None]
    counts, seen, kinds = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, set(), []
    for _, role, text in rows:
        stripped = text.strip(BLANK)
        kind = "blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated"
        seen.add((role, text))
        kinds.append(kind)
        counts[kind] += 1
    legal, after = {"": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def insert(best):
        for _ in range(3):
            for last, (cost, audit, lines) in list(best.items()):
                for c in legal[last].replace("s", ""):
                    new = (cost + 5, audit + "I", [*lines, after[c] + ":"])
                    if c not in best or new[:2] < best[c][:2]:
                        best[c] = new
        return best
    best = insert({"": (0, "", [])})
    for (_, role, text), kind in zip(rows, kinds):
        now = {}
        for last, (cost, audit, lines) in best.items():
            options = [(cost + 2, audit + "D", lines, last)]
            if kind not in ("blank", "duplicate"):
                extra = 5 * (kind == "truncated")
                if role[:1] and role[:1] in legal[last]:
                    options.append((cost + extra, audit + "K", [*lines, f"{role}:{text}"], role[:1]))
                options += [(cost + 1 + extra, audit + "R", [*lines, f"{after[c]}:{text}"], c) for c in legal[last].replace("s", "")]
            for *new, c in options:
                if c not in now or tuple(new[:2]) < now[c][:2]:
                    now[c] = tuple(new)
        best = insert(now)
    cost, audit, lines = min((best[c] for c in ("", "a") if c in best), key=lambda b: b[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, "\n".join(lines))


def collocations(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from plain counts of all phrases of one to three words."""
    f, n = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i:i + size])] += 1
    out = []
    for lang, counts in f.items():
        covered = {p for t, c in counts.items() if len(t) == 3 and c >= least for p in (t[:2], t[1:]) if 100 * c >= 50 * counts[p]}
        rows = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least and p not in covered:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top])]
    return out
