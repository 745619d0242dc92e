"""Plain, single-process versions of what the operators compute."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from prismlake.llm import langid, toxicity
from prismlake.llm.ngrams import gram_slots


def toxicity_scores(train, texts):
    """Dense: grams of each text as a set, log-count ratios, ridge logistic regression by full Newton steps."""
    sets = [set(gram_slots(t.lower(), toxicity.SIZES, toxicity.BITS).tolist()) for t, _ in train]
    y = np.array([label for _, label in train], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return [share] * len(texts)
    every = sorted(set().union(*sets))
    held = np.array([[g in s for g in every] for s in sets])
    with_1, with_0 = held[y == 1].sum(0), held[y == 0].sum(0)
    pooled = (with_1 + with_0) / len(y)
    z = np.abs(with_1 / n1 - with_0 / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n1 + 1 / n0))
    keep = (with_1 + with_0 >= 3) & (z >= toxicity.LEAST_Z)
    strongest = sorted(np.flatnonzero(with_1 + with_0 >= 3).tolist(), key=lambda k: (-z[k], every[k]))[: toxicity.LEAST_FEATURES]
    keep[strongest] = True
    ratio = (np.log((with_1 + 1.0) / (with_1.sum() + 1)) - np.log((with_0 + 1.0) / (with_0.sum() + 1)))[keep]
    x = np.c_[held[:, keep] * ratio, np.ones(len(y))]
    penalty = np.r_[np.full(keep.sum(), toxicity.RIDGE), 1e-6]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w -= np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    grams = np.array(every)[keep]
    scores = []
    for t in texts:
        own = set(gram_slots((t or "").lower(), toxicity.SIZES, toxicity.BITS).tolist())
        row = np.r_[np.array([g in own for g in grams.tolist()], float) * ratio, 1.0]
        scores.append(1 / (1 + np.exp(-np.clip(row @ w, -35, 35))))
    return scores


def languages(train, texts):
    """(language, posterior) of each text, one n-gram at a time."""
    train = [(t, k) for t, k in train if t is not None and k is not None]
    names = sorted({k for _, k in train})
    counts = {k: np.zeros(1 << langid.BITS) for k in names}
    for t, k in train:
        for slot in gram_slots(t.lower(), langid.SIZES, langid.BITS).tolist():
            counts[k][slot] += 1
    log_p = {k: np.log(c + langid.SMOOTHING) - np.log(c.sum() + langid.SMOOTHING * len(c)) for k, c in counts.items()}
    found = []
    for t in texts:
        if not names or t is None or not any(c.isalpha() for c in t):
            found.append(("und", 0.0))
            continue
        slots = gram_slots(t.lower(), langid.SIZES, langid.BITS).tolist()
        total = np.array([np.log(sum(k == name for _, k in train) / len(train)) + sum(log_p[name][s] for s in slots) for name in names])
        found.append((names[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())))
    return found


def components(texts):
    """Shingle sets and smallest reachable index, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return sets, root


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets of {source: size} by sharing again and again until none is over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed = {s: 0.0 for s in names if not sizes[s]}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def copies(spark, rows, seed=17, share=0.001):
    """{(id, text, source): list of copies} of rows (id, text, source), row by row."""
    size = [len((t or "").split()) for _, t, _ in rows]
    own = {s: sum(n for n, (_, _, of) in zip(size, rows) if of == s) for s in {r[2] for r in rows}}
    target = targets(own)
    keys = [r[0] for r in spark.createDataFrame([(t,) for _, t, _ in rows], "t string").coalesce(1).select(F.xxhash64("t")).collect()]
    found = {}
    for s in own:
        order = lambda k: (rows[k][0] is not None, rows[k][0] or 0, keys[k])
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        expected, spent = 0.0, 0
        large = [k for k in mine if size[k] > max(0, target[s] * share)]
        for k in sorted(large, key=lambda k: (-size[k], rows[k][0] is None, rows[k][0] or 0, keys[k])):
            expected += target[s] / own[s] * size[k]
            n = min(3, max(0, int(np.floor((expected - spent) / size[k] + 0.5))))
            spent += n * size[k]
            found.setdefault(rows[k], []).append(n)
        small = sorted((k for k in mine if k not in large), key=lambda k: (size[k], *order(k)))
        open_ = sum(size[k] for k in small)
        rate = min(3.0, max(0.0, (target[s] - spent) / open_)) if open_ else 0.0
        draw = spark.range(1).select((F.pmod(F.xxhash64(F.lit(s or ""), F.lit(s is None), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).alias("d")).first().d
        for p, k in enumerate(small):
            found.setdefault(rows[k], []).append(min(3, int(np.floor((p + 1) * rate + draw) - np.floor(p * rate + draw))))
    return found


def part(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def digests(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
