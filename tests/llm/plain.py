"""Plain Python versions of what the operators compute, for comparison; quadratic where that is simplest."""

import hashlib
import math
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows that every operator has to take: nulls, empty, blank, ties, repeats, a lone word, other scripts.
ODD = [None, "", " \t\n", "one", "One", "a b", "a b", "äöü ß 漢字  x", "\u0085", "x" * 3000, "--- ???"]

BASE = {
    "assign": (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def secrets(text):
    found = []
    for k, (kind, (rx, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in rx.finditer(text or "") if len(m[group]) >= least]
    found = [x for _, _, x in sorted(found)]
    return [sum(x.startswith(k) for x in found) for k in BASE], hashlib.sha256(",".join(found).encode()).hexdigest()


def all_spans(text, more):
    """All spans, of the base and of further rules, joined; Python's own expressions over bytes, places in code points."""
    raw = (text or "").encode()
    found = [(m.start(), k, m.end(), kind) for k, (kind, (rx, group, least)) in enumerate(BASE.items()) for m in rx.finditer(text or "") if len(m[group]) >= least]
    for k, rule in enumerate(more, len(BASE)):
        for m in re.finditer(f"(?:{rule.head})(?P<body>{rule.body})".encode(), raw):
            if len(m["body"]) >= rule.least:
                found.append((len(raw[: m.start()].decode("utf-8", "replace")), k, len(raw[: m.end()].decode("utf-8", "replace")), rule.kind))
    return ",".join(f"{kind}:{start}:{end}" for start, k, end, kind in sorted(found))


def licence_labels(docs, templates, base, rare=8, slack=4, share=0.6, floor=3.0, least=2, order=None):
    """[(labels, score)] of docs (lists of words): every beginning of every template is tried. order: of equally rare words."""
    known = {w for t in templates for w in t.text.split()}
    seen = {w: sum(w in d for d in map(set, docs)) for w in known}
    idf = {w: math.log((len(docs) + 1) / n) if n else math.inf for w, n in seen.items()}

    def stands(phrase, words):
        p = phrase.split()
        return any(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1))

    out = []
    for words in docs:
        labels = {label for phrase, label in base if stands(phrase, words)}
        score = 1.0 if labels else 0.0
        for t in templates:
            own = t.text.split()
            ranked = sorted(set(own), key=lambda w: (-idf[w], order(w)))[:rare]
            ranked = [w for k, w in enumerate(ranked) if k < least or idf[w] >= floor]
            votes = [(i - p, w) for i, w in enumerate(words) for p, o in enumerate(own) if w == o and w in ranked]
            for last in {b for b, _ in votes}:
                near = [(b, w) for b, w in votes if last - slack <= b <= last]
                part, begin = len({w for _, w in near}) / len(ranked), min(near)[0]
                stretch = words[max(0, begin - slack) : begin + len(own) + 2 * slack]
                if part >= share and len({w for _, w in near}) > 1 and all(stands(k, stretch) for k in t.keys):
                    labels.add(t.label)
                    score = max(score, part)
        out.append((",".join(sorted(labels)), score))
    return out


def words(text):
    return SPACED.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_components(docs, n, percent=80):
    """{row: smallest doc_id}, sizes."""
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if r not in least else min(least[r], d)
    return [(docs[i][0], len(sets[i]), least[find(i)], docs[i][0] == least[find(i)]) for i in range(len(docs))]


def without_repeats(texts, length=400):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed, n=60, most=120):
    """Random texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(80)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, most))))
    return texts
