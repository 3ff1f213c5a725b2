"""Each contract once more, in the plainest form: no numpy, no Spark, no shared code with the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def op1(docs, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for item, text in bench:
        w = word.findall((text or "").translate(FOLD))
        if item is None or not w:
            continue
        size = min(13, len(w))
        for i in range(len(w) - size + 1):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = word.findall((text or "").translate(FOLD))
        hit, items = set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in wins:
                    hit.update(range(i, i + size))
                    items |= wins[k]
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def _repeated(sequences, size):
    count = Counter(tuple(s[i : i + size]) for s in sequences for i in range(len(s) - size + 1))
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - size + 1):
            if count[tuple(s[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        yield gone


def op2(docs, size=200):
    texts = [(t or "").encode() for _, t in docs]
    out = []
    for (doc, _), b, gone in zip(docs, texts, _repeated(texts, size), strict=True):
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def op3(docs, num=9, den=10, size=3):
    sets = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(FOLD))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if docs[i][0] == docs[j][0] or (a and b and den * len(a & b) >= num * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc)
    return [(doc, len(sets[i]), min(groups[find(i)])) for i, (doc, _) in enumerate(docs)]


def op4_base(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def op6(docs, size=35):
    words = [WORD.findall(t or "") for _, t in docs]
    return [
        (doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
        for (doc, _), w, gone in zip(docs, words, _repeated(words, size), strict=True)
    ]


def op7(docs, least=40, most=5):
    key = lambda line: line.strip(BLANK).translate(FOLD)
    holders = {}
    for r, (doc, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                holders.setdefault(k, []).append(r)
    low = -(1 << 63)
    keep = {k: max(low if docs[r][0] is None else docs[r][0] for r in rows) for k, rows in holders.items() if len(rows) >= most}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == (low if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return out


def op9_base(text):
    text = text or ""
    w = WORD.findall(text)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            rep.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), failed
