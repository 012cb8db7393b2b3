"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def repeats(docs):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} of docs [(doc_id, text)]."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = [False] * (len(raw) + 1)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(w)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(raw)))
        out[i] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=False) if not g)))
    return out


def contamination(docs, items):
    """[(doc_id, n_words, n_hit, n_items, sha, contaminated)]."""
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        if i is not None:
            for k in range(max(1, len(w) - 9)) if w else ():
                windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    """[(kind, start, end)] of the base patterns, by kind, then start."""
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


SECRETS = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def secrets(text):
    """[(kind, start, end)] of the base patterns, by start, then kind."""
    out = []
    for rank, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text or "", re.A):
            if len(m.group(2)) >= 6 if kind == "assign" else len(m.group()) >= (20 if kind == "access" else 24):
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near(docs):
    """{doc_id: (n_shingles, component_id)}."""
    sets = {i: shingles(t) for i, t in docs}
    parent, where = {i: i for i in sets}, defaultdict(list)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                shared[j] += 1
            where[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def owned_secrets(rows, further, limit):
    """[(doc_id, spans, n_live, n_copied, n_repositories)] of rows [(doc_id, text, owner, repository)]."""
    holders, found = defaultdict(set), []
    for _, text, owner, repository in rows:
        base = secrets(text)
        more = [(k, m.start(), m.end()) for k, p in further.items() for m in re.finditer(p, text or "", re.A)]
        more = [x for x in more if not any(a <= x[1] and x[2] <= b for _, a, b in base)]
        values = {}
        for kind, a, b in base + more:
            m = (text or "")[a:b]
            values[kind, a, b] = re.fullmatch(SECRETS["assign"], m).group(2) if kind == "assign" else m.lower() if kind == "upper" else m
            holders[values[kind, a, b]].add((owner, repository))
        found.append((base, more, values))
    out = []
    copied = {v for v, h in holders.items() if len({owner for owner, _ in h}) >= limit}
    for (i, *_), (base, more, values) in zip(rows, found, strict=True):
        every = base + [x for x in more if values[x] not in copied]
        rank = [*SECRETS, "other"]
        every.sort(key=lambda x: (x[1], rank.index(x[0] if x[0] in SECRETS else "other"), x[0]))
        own = set(values.values())
        out.append((i, every, len(own - copied), len(own & copied), max((len(holders[v]) for v in own), default=0)))
    return out


class Ftrl:
    """FTRL-Proximal over dicts {feature: value}."""

    def __init__(self, alpha, l1, l2):
        self.alpha, self.l1, self.l2, self.z, self.n = alpha, l1, l2, defaultdict(float), defaultdict(float)

    def weight(self, f):
        z = self.z[f]
        return 0.0 if abs(z) <= self.l1 else (math.copysign(self.l1, z) - z) / ((1 + math.sqrt(self.n[f])) / self.alpha + self.l2)

    def score(self, x):
        return 1 / (1 + math.exp(-sum(self.weight(f) * v for f, v in x.items())))

    def fit(self, rows, labels, epochs):
        order = np.random.default_rng(1)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                w, off = {f: self.weight(f) for f in rows[i]}, self.score(rows[i]) - labels[i]
                for f, v in rows[i].items():
                    g, n = off * v, self.n[f]
                    self.z[f] += g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w[f]
                    self.n[f] = n + g * g
        return self


def quality_features(text):
    tokens = re.findall(r"[a-z0-9]+|[!-/:-@\[-`{-~]+", text.lower())
    grams = Counter(tokens) + Counter(zip(tokens, tokens[1:], strict=False))
    n = grams.total()
    return {"bias": 1.0} | {g: 8.0 * c / math.sqrt(max(n, 1)) / math.sqrt(max(n, 16)) for g, c in grams.items()}


def toxic_features(text):
    words = set(re.findall(r"[a-z0-9]+", text.lower()))
    return {(0, w) for w in words} | {(1, w[:k], k) for w in words for k in (4, 5) if len(w) > k}


def toxic_chain(texts, labels, folds=3):
    """Models of the chain: each [(features that are weighed, Ftrl)], fitted with out-of-fold probabilities before it."""
    rows = [toxic_features(t) for t in texts]

    def told(ids):
        bad, good = Counter(f for i in ids if labels[i] for f in rows[i]), Counter(f for i in ids if not labels[i] for f in rows[i])
        n_bad = max(sum(labels[i] for i in ids), 1)
        n_good, base = max(len(ids) - sum(labels[i] for i in ids), 1), n_bad / len(ids)
        cue = {f for f, b in bad.items() if b >= 8 and good[f] * n_bad <= 0.02 * b * n_good}
        telling = {f for f, b in bad.items() if b >= 3 and b >= 3.0 * base * (b + good[f])}
        marks = [{i: float(labels[i] and any(f[0] == kind for f in rows[i] & cue)) for i in ids} for kind in (0, 1)]
        return telling, [*marks, {i: float(labels[i]) for i in ids}]

    def inputs(i, telling, before):
        return {"bias": 1.0} | dict(enumerate(before[i])) | dict.fromkeys(sorted(rows[i] & telling), 1.0)

    parts = [[i for i in range(len(rows)) if i % folds != p] for p in range(folds)] + [list(range(len(rows)))]
    known, before, chain = [told(ids) for ids in parts], [[] for _ in rows], []
    for k in range(3):
        models = [Ftrl(0.3, 1.0, 0.1).fit([inputs(i, t, before) for i in ids], [m[k][i] for i in ids], 2) for ids, (t, m) in zip(parts, known, strict=True)]
        before = [b + [models[i % folds].score(inputs(i, known[i % folds][0], before))] for i, b in enumerate(before)]
        chain.append((known[-1][0], models[-1]))
    return chain


def toxic_scores(text, chain):
    out = []
    for telling, model in chain:
        out.append(model.score({"bias": 1.0} | dict(enumerate(out)) | dict.fromkeys(toxic_features(text) & telling, 1.0)))
    return out
