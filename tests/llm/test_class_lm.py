import random
import zlib
from collections import Counter

import numpy as np

from tessella.llm import class_lm as M


def make_docs(n=400):
    rng = random.Random(3)
    kinds = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    rows = []
    for d in range(n):
        words, kind = [], rng.randrange(3)
        for _ in range(rng.randint(5, 60)):
            words.append(rng.choice(kinds[kind]) if rng.random() < 0.95 else f"rare{rng.randint(0, 3000)}")
            kind = (kind + 1) % 3 if rng.random() < 0.9 else rng.randrange(3)
        rows.append((d, " ".join(words).upper() if d % 7 == 0 else "\n".join(words), "x"))
    return [*rows, (1000, None, "x"), (1001, "", "x"), (None, "a1 b1 c1", "x"), (1002, "a1 " * 5000, "x"), (1002, "a1 " * 5000, "x")]


def test_scores(spark):
    rows = make_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string")
    got = M.score_documents(docs, frequent=60, classes=6).collect()
    assert len(got) == len(rows)
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").lower().split(), None]
    counts = Counter(w for d, t, _ in rows if not out(d) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    texts = {d: t for d, t, _ in rows}
    for r in got:
        t = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(t), sum(counts[w] > 0 for w in t), total)
        assert abs(r.base_score - sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)) < 1e-6
        assert np.isfinite(r.score) and r.score < 0
    held = [r for r in got if r.held_out]
    own, base = (-sum(getattr(r, c) for r in held) / sum(r.n_tokens for r in held) for c in ("score", "base_score"))
    assert 10**own < 0.6 * 10**base  # held-out perplexity against the base model's
    assert M.score_documents(docs.limit(0)).count() == 0


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(2)
    truth = np.arange(30) % 3
    bigrams = np.zeros((32, 32), np.int64)
    for _ in range(20000):
        w = rng.integers(30)
        bigrams[w, rng.choice(np.flatnonzero(truth == (truth[w] + 1) % 3))] += 1
    shuffled = rng.permutation(30)
    grid = bigrams.copy()
    grid[:30, :30] = bigrams[np.ix_(shuffled, shuffled)]
    own = M.exchange(grid, 3)[:30]
    assert all(len(set(own[truth[shuffled] == k])) == 1 for k in range(3)) and len(set(own)) == 3


def test_gains_are_changes_of_the_likelihood():
    """Against the likelihood of the table with the word moved, for every word and class."""
    rng = np.random.default_rng(4)
    words, k = 9, 3
    own = np.array([*rng.integers(0, k, words), k + 1])  # the last word is the end
    bigrams = rng.integers(0, 6, (words + 1, words + 1))

    def table(of):
        out = np.zeros((k + 2, k + 2))
        np.add.at(out, (of[:, None], of[None, :]), bigrams)
        return out

    of = lambda w, axis: np.bincount(np.delete(own, w), np.delete(bigrams[:, w] if axis else bigrams[w], w), k + 2)
    left, right = (np.array([of(w, axis) for w in range(words)], np.int64) for axis in (1, 0))
    got = M.gains(table(own), own[:words], left, right, np.diag(bigrams)[:words], k)
    for w in range(words):
        moved = [M.likelihood(table(np.where(np.arange(words + 1) == w, c, own))) for c in range(k)]
        assert np.allclose(got[w] - got[w, 0], np.array(moved) - moved[0])


def trained(spark, rows, **how):
    """The model and, of every word, its training count and class."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string")
    blocks = M.blocks_of(docs, 2000)
    blocks.cache()
    answers, model, tokens, distinct = M.train(blocks, 4, **how)
    found = {r.block: [] for r in answers.collect()}
    for r in sorted(answers.collect(), key=lambda r: r.bucket):
        found[r.block].append(r)
    known = {}
    for row in blocks.collect():
        of = M._Block(row.asDict())
        order, _ = M._dealt(of.names, 4)
        counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in found[of.block]])
        classes = np.concatenate([np.frombuffer(r.classes, np.uint8) for r in found[of.block]])
        for name, n, c in zip(of.names[order].tolist(), counts.tolist(), classes.tolist(), strict=True):
            assert known.setdefault(name, (n, c)) == (n, c)
    return model, known, tokens, distinct


def test_scores_follow_from_the_classes(spark):
    """The whole score against a model counted word by word from the classes that were found."""
    rows = make_docs(250)
    _, known, total, _ = trained(spark, rows, frequent=40, classes=5)
    name = lambda w: int(M._Texts().tokens([w])[0][0])
    line = lambda t: [known[name(w)] for w in (t or "").lower().split()] + [known[int(M.END)]]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    moves, hapax, totals = Counter(), Counter(), Counter()
    for d, t, _ in rows:
        before = 6
        for n, c in line(t) if not out(d) else []:
            moves[before, c] += 1
            hapax[before] += n == 1
            totals[c] += 1
            before = c
    after = Counter()
    for (a, _), n in moves.items():
        after[a] += n
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string")
    got = M.score_documents(docs, frequent=40, classes=5, load=2000).collect()
    want = []
    for d, t, _ in rows:
        before, score = 6, 0.0
        for n, c in line(t):
            unseen = min((hapax[before] + 0.5) / (after[before] + 1), 0.5)
            p = (1 - unseen) * (M.MIX * moves[before, c] / after[before] * n / totals[c] + (1 - M.MIX) * n / total) if n else unseen
            score += np.log10(p)
            before = c
        want.append((d, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (d, x), (e, y) in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert d == e and abs(x - y) < 1e-6 * max(1, abs(y))


def test_probabilities_sum_to_one(spark):
    model, known, total, distinct = trained(spark, make_docs(250), frequent=40, classes=5)
    seen = [(n, c) for n, c in known.values() if n]
    assert len(seen) == distinct and sum(n for n, _ in seen) == total
    counts, classes = (np.array(x) for x in zip(*seen, strict=True))
    for before in sorted(set(classes.tolist())):
        p = 10 ** model.log10(np.full(len(seen), before), classes, counts, total)
        assert abs(p.sum() + model.unseen[before] - 1) < 1e-9


def test_a_sweep_moves_all_words(spark):
    """Words that alternate in three classes, with only some of ninety clustered at first."""
    rows = [(d, " ".join(w for w in t.split() if "rare" not in w.lower()), s) for d, t, s in make_docs(400)[:400]]
    _, known, _, _ = trained(spark, rows, frequent=12, classes=3, sweeps=4)
    kinds = {k: Counter(known[int(M._Texts().tokens([f"{k}{i}"])[0][0])][1] for i in range(30)) for k in "abc"}
    assert len({c.most_common(1)[0][0] for c in kinds.values()}) == 3 and all(c.most_common(1)[0][1] >= 27 for c in kinds.values())
