"""Language ID against plain loops: another solver for the support vector machines, features and duels one document at a time."""

import math

import numpy as np

from lexweave.llm import langid


def plain_svm(x, y, c=10.0):
    """The primal of the same problem, by Newton steps on what lies inside the margin; a column of ones is the bias."""
    rows, theta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y) * c

    def objective(t):
        return 0.5 * t @ t + (weight * np.maximum(0, 1 - y * (rows @ t)) ** 2).sum()

    for _ in range(100):
        inside = y * (rows @ theta) < 1
        part, own = rows[inside], weight[inside]
        gradient = theta - 2 * part.T @ (own * y[inside] * (1 - y[inside] * (part @ theta)))
        step, size = np.linalg.solve(np.eye(len(theta)) + 2 * part.T @ (own[:, None] * part), gradient), 1.0
        while size > 1e-6 and objective(theta - size * step) > objective(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(gradient).max() < 1e-8:
            break
    return theta, objective


def test_support_vectors_equal_another_solver():
    rng = np.random.default_rng(2)
    for n, d, share in ((120, 8, 0.5), (200, 30, 0.2), (60, 90, 0.4)):
        y = np.where(rng.random(n) < share, 1, -1)
        x = rng.normal(size=(n, d)) + 1.5 * y[:, None] * (np.arange(d) < 3)
        want, objective = plain_svm(x, y)
        w, bias = langid.linear_svm(x.astype(np.float32), y, rounds=400)
        got = np.append(w, bias)
        assert objective(want) <= objective(got) <= 1.01 * objective(want)
        usual = np.append(*langid.linear_svm(x.astype(np.float32), y))
        assert np.mean(np.sign(x @ usual[:-1] + usual[-1]) == np.sign(x @ want[:-1] + want[-1])) >= 0.95


def plain_features(text):
    """Letters, pairs and triples of a text's words, each word between zeros, by 32-bit hashes."""
    m, counts = 1 << 32, {}
    words, word = [], []
    for c in (text or "").lower():
        if c.isalpha():
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    words += [word] if word else []
    if not words:
        return None
    codes = [0]
    for w in words:
        codes += [*w, 0]
    hashed = [c * 0x9E3779B1 for c in codes if c]
    two = [(a * 0x85EBCA6B + b * 0xC2B2AE35) % m for a, b in zip(codes, codes[1:], strict=False)]
    hashed += two + [(a * 0x27D4EB2F + b * 0x165667B1) % m for a, b in zip(two, codes[2:], strict=False)]
    for h in hashed:
        h %= m
        h ^= h >> 15
        at = (h * 0x2C1B3C6D % m) >> (32 - langid.BUCKETS.bit_length() + 1)
        counts[at] = counts.get(at, 0) + 1
    total = sum(counts.values())
    return {at: math.sqrt(n / total) for at, n in counts.items()}


def plain_predict(model, text):
    x = plain_features(text)
    if x is None:
        return "und", 0.0
    sure = lambda margin: 1 / (1 + math.exp(-3 * margin))
    margin = lambda side, k: sum(v * float(side[0][at, k]) for at, v in x.items()) + float(side[1][k])
    margins = [margin(model.family, k) for k in range(len(model.families))]
    order = sorted(range(len(margins)), key=lambda k: -margins[k])
    score, names = sure((margins[order[0]] - margins[order[1]]) / 2), model.families[order[0]]
    duels = {pair: margin(model.within[order[0]], k) for k, pair in enumerate(model.pairs[order[0]])}
    wins = {a: sum(d > 0 if p[0] == a else d <= 0 for p, d in duels.items() if a in p) for a in range(len(names))}
    won = max(wins, key=wins.get)
    return names[won], score * sure(min(d if p[0] == won else -d for p, d in duels.items() if won in p)) if duels else score


def test_predictions_equal_plain_loops(spark, documents):
    model = langid.fit(documents)
    assert [len(f) for f in model.families] == [2, 2]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents).collect()}
    for r in documents.collect():
        label, score = plain_predict(model, r.text)
        assert got[r.doc_id][0] == label and abs(got[r.doc_id][1] - score) < 1e-3


def test_floors_come_from_every_labelled_document(spark, documents):
    """Means and floors by plain loops over all documents that may be learned from; the classifiers' sample does not change them."""
    learn = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 3 <> 1").select("doc_id", "text", "lang")
    few, many = (langid.fit(documents, sample=n, floors=True) for n in (8, 400))
    assert few.floors == many.floors and len(few.floors[0]) >= 5 and np.array_equal(few.means, many.means)

    def dense(text):
        x = np.zeros(langid.BUCKETS)
        for at, v in (plain_features(text) or {}).items():
            x[at] = v
        return x

    rows = [(r.lang, r.text, x) for r in learn.collect() if (x := dense(r.text)).any()]
    unit = lambda v: v / np.linalg.norm(v)
    sums = {label: sum(x for own, _, x in rows if own == label) for label in sorted({r[0] for r in rows})}
    assert np.abs(many.means - np.array([unit(v) for v in sums.values()]).T).max() < 1e-5
    for length, floor in ((25, many.floors[1][0]), (200, many.floors[1][3])):
        near = [max(dense(t[:length]) @ unit(v - x if label == own else v) for label, v in sums.items()) for own, t, x in rows if len(t) >= length]
        low, middle, high = np.quantile(near, [0.25, 0.5, 0.75])
        assert floor <= middle - langid.SPREADS * (high - low) / 1.349 + 2e-3
    # a row that is there twice is learned from once
    twice = langid.fit(documents.unionAll(documents.where("doc_id < 50")), floors=True)
    assert twice.floors == many.floors and np.array_equal(twice.means, many.means)
