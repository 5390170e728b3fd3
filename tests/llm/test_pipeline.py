"""The pipeline against a brute-force version of its stages, on small rows with every awkward case."""

import hashlib
import random
import re
import string

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tessella.llm import bpe, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n)]


def make_rows():
    rng = random.Random(7)
    rows, base = [], [words_of(rng, rng.randint(60, 140)) for _ in range(40)]
    for i in range(160):
        w = list(base[i % 40])
        if i >= 40 and i % 3:
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 99))
        text = " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :])
        rows.append((i, text.upper() if i % 17 == 3 else text, ["en", "de", None][i % 3], ["s0", "s1", None, "s2"][i % 4]))
    rows += [(900, None, "en", "s0"), (901, "", None, None), (902, "too short", "en", "s1"), (903, "#### $$$$ " * 60, "en", "s0"), (904, "one two three " * 40, "de", "s1")]
    return rows


def brute_quality(rows):
    def ratios(t):
        w = WORD.findall(t or "")
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        mille = lambda a, b: a * 1000 // b if b else 0
        joined = "".join(w)
        return (len(w) < 50 or 100 * len(covered) > 50 * len(w)), {
            "symbols": mille(len(re.findall(r"[#*$%&|<>]", joined)), chars), "dup_lines": mille(len(lines) - len(set(lines)), len(lines)),
            "repeats": mille(len(covered), len(w)), "capitals": mille(len(re.findall("[A-Z]", joined)), chars)}

    found = {r[0]: ratios(r[1]) for r in rows}
    bucket = lambda v: v >> max(v.bit_length() - 8, 0) << max(v.bit_length() - 8, 0)
    kept = []
    for r in rows:
        peers = [found[x[0]][1] for x in rows if x[2:] == r[2:]]
        bad, own = found[r[0]]
        for k, slack in quality.SLACK.items():
            values = sorted(bucket(p[k]) for p in peers)
            q = lambda n: next(v for i, v in enumerate(values, 1) if 4 * i >= n * len(values))  # noqa: E731, B023
            bad = bad or own[k] > q(3) + 3 * max(q(3) - q(1), slack)
        if not bad:
            kept.append(r)
    return kept


def brute_exact(rows):
    best = {}
    for r in rows:
        best[(r[1] or "").translate(LOWER)] = max(r, best.get((r[1] or "").translate(LOWER), r), key=lambda x: x[0])
    return list(best.values())


def brute_near(rows, k=5, percent=80):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return [r for r in rows if top(r[0]) == r[0]]


def brute_mix(rows):
    size = lambda r: len(WORD.findall(r[1] or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 2 * total[s]}
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
        if not over or not free:
            break
    target |= {s: weight[s] * level for s in free}
    out = []
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        part, run = target[s] - whole * total[s], 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"17:{r[0]}".encode()).hexdigest(), r[0])):
            copies = min(whole + (run + size(r) / 2 <= part), 2)
            run += size(r)
            out += [r] * copies
    return out


def test_against_brute_force(spark, tmp_path):
    rows = make_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute_quality(rows)
    assert {3, 20} & {r[0] for r in rows} and not {900, 901, 902, 903, 904} & {r[0] for r in kept}
    want = brute_mix(brute_near(brute_exact(kept)))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r[0], r[2], r[3], np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in want) if all(None not in r[:1] for r in want) else []
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.where("not decodes").isEmpty()
    assert sorted(((r.doc_id, r.lang, r.source, bytes(r.ids)) for r in got.collect()), key=lambda x: (x[0], x[3])) == sorted(want, key=lambda x: (x[0], x[3]))


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "word " * 3 + "x", "en", "s0", 9), (None, None, None, None, None), (1, "word " * 3 + "x", "en", "s0", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()
