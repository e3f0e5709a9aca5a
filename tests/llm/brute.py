"""The contracts of the numbered queries in plain Python, for small inputs."""

import hashlib
import math
import re
import string
from collections import Counter

import numpy as np

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    places = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def license_evidence(text, templates, common, gap, share):
    """labels and score of a text: of all passages, the most pairs that stand in order on neighbouring diagonals."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    base = licenses(text)
    labels, score = set(filter(None, base[4].split(","))), float(base[1] > 0)
    for passage, label in templates.items():
        t = passage.split(" ")
        pairs = {i: (a, b) for i, (a, b) in enumerate(zip(t, t[1:])) if not (a in common and b in common)}
        hits = [(p, i) for p in range(len(words) - 1) for i, ab in pairs.items() if (words[p], words[p + 1]) == ab]
        votes = Counter(p - i for p, i in hits)
        score = max([score, *(n / len(pairs) for n in votes.values())])
        for d in votes:
            here = sorted(((p, -i) for p, i in hits if d <= p - i <= d + gap))
            if len(here) < share * len(pairs):
                continue
            longest = {}
            for p, i in here:  # by place, so that an earlier one of the same place never counts twice
                longest[-i] = max(longest.get(-i, 0), 1 + max((n for j, n in longest.items() if j < -i), default=0))
            found = max(longest.values()) / len(pairs)
            if found >= share:
                labels.add(label)
                score = max(score, found)
    return ",".join(sorted(labels)), score


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    n = Counter(x[2] for x in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, inside = Counter(runs), set()
    for i, run in enumerate(runs):
        if n[run] > 1:
            inside.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def least_determinant(x, floors, core, first_steps, more_steps, chi_median):
    """Center and scatter of rows by concentration steps from three starts, as numpy does it."""
    rank = lambda v, q: np.sort(v, axis=0)[math.ceil(q * len(v)) - 1]
    d = x.shape[1]
    distances = lambda c, s: np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s + np.diag(floors**2)), x - c)

    def step(c, s):
        d2 = distances(c, s)
        near = x[d2 <= rank(d2, core)]
        return near.mean(axis=0), np.cov(near.T, bias=True)

    center = rank(x, 0.5)
    sd = 1.4826 * rank(np.abs(x - center), 0.5)
    z = (x - center) / (sd + floors)
    scatters = [np.diag(sd**2)]
    for u in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]):
        m = u.T @ u / len(u)
        r = m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
        scatters.append(np.where(np.eye(d) > 0, 1.0, r) * np.outer(sd, sd))
    ends = []
    for s in scatters:
        c = center
        for _ in range(first_steps):
            c, s = step(c, s)
        ends.append((np.linalg.slogdet(s + np.diag(floors**2))[1], len(ends), c, s))
    _, _, c, s = min(ends, key=lambda e: e[:2])
    for _ in range(more_steps):
        c, s = step(c, s)
    return c, max(1.0, rank(distances(c, s), 0.5) / chi_median) * (s + np.diag(floors**2))


def url(address):
    host, path = "", ""
    if "://" in (address or ""):
        rest = address.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOW)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(docs, width, p, q):
    """doc_id: (set size, smallest linked doc_id), for distinct doc_ids."""
    sets = {i: shingles(t, width) for i, t in docs}
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and q * both >= p * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}
