"""Exact, near and substring dedup against brute force, with nulls, ties, repeated rows, long and empty texts."""

import hashlib
import random
import string

import pytest

from tessella.llm import anchors, automaton_dedup, block_dedup, near_dups, suffix_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Extra columns whose names clash with the operators' own.
CLASH = "doc_id long, text string, name string, size long, sha string, v long, g long, d long, th long, places string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "s", 2, 3, 4, 5, "p") for i, t in rows], CLASH)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact_groups(spark):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcABC é\n", k=n)) for n in (1, 5, 40, 2047, 2048, 2049, 4096, 9000, 30000)]
    rows = [(i, base[i % len(base)].upper() if i % 5 == 0 else base[i % len(base)]) for i in range(60)]
    rows += [(100, None), (101, ""), (102, base[7][:-1] + "x"), (103, base[7][:4500] + "y" + base[7][4501:]), (104, "É"), (105, "é"), (100, None), (7, rows[7][1])]
    got = {}
    for r in block_dedup.exact_groups(frame(spark, rows), block=2048).collect():
        got.setdefault((r.doc_id, r.text_sha256), []).append(r)
    norm = [(i, (t or "").translate(LOWER)) for i, t in rows]
    assert sum(map(len, got.values())) == len(rows)
    for i, t in norm:
        peers = [j for j, u in norm if u == t]
        for r in got[i, sha(t.encode())]:
            assert (r.keep_id, r.group_size, r.kept) == (max(peers), len(peers), i == max(peers))


def test_exact_groups_by_short_blocks(spark):
    rows = [(i, t) for i, t in enumerate(["abcdefgh" * 9, "abcdefgh" * 9, "abcdefgh" * 8 + "abcdefgx", "abcdefgh" * 4 + "Xbcdefgh" + "abcdefgh" * 4, "abcdefgh" * 4 + "xbcdefgh" + "abcdefgh" * 4])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in block_dedup.exact_groups(frame(spark, rows), block=4).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (4, 2), 4: (4, 2)}


def test_exact_edges(spark):
    assert block_dedup.exact_groups(frame(spark, [(1, "a")]).limit(0)).count() == 0
    out = block_dedup.drop_copies(frame(spark, [(1, "a"), (1, "a"), (1, "A"), (2, "b"), (None, "b"), (None, "c"), (None, None)]))
    assert sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").lower()) for r in out.collect())) == [(False, 1, "a"), (False, 2, "b"), (True, 0, ""), (True, 0, "c")]
    assert out.columns == frame(spark, [(1, "a")]).columns


def brute_components(rows, k, percent):
    def shingles(t):
        w = (t or "").translate(LOWER).encode().split()
        return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                top[find(a)] = find(b)
    out = []
    for n, (i, s) in enumerate(sets):
        peers = [sets[m][0] for m in range(len(sets)) if find(m) == find(n) and sets[m][0] is not None]
        out.append((i, len(s), None if i is None else min(peers)))
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_near_components(spark, k, percent):
    rng = random.Random(k)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(14):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [word()], [w[at], word()]]) if len(w) > 3 else [w[at]]
            if g % 4 == 0:
                w = passage + w
            rows.append((len(rows), (" " if g % 2 else "\n").join(w).upper() if g % 3 == 0 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t "), (503, "one"), (504, "ONE"), (505, "one two"), (506, "two one"), (None, rows[0][1]), (0, rows[0][1]), (7, "x y z " * 3000)]
    got = [tuple(r) for r in near_dups.near_components(frame(spark, rows), k, percent).collect()]
    by = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    want = brute_components(rows, k, percent)
    assert sorted(got, key=by) == sorted(want, key=by)


def test_sets_are_moved_and_texts_are_not(spark):
    texts = [(i, f"w{i} x{i} y{i} z{i} u{i}") for i in range(50)]
    rows = frame(spark, [*texts, (3, "another text under one id"), (None, texts[4][1]), (-7, None)])
    named = near_dups.prefixes(rows, 4, 85)[0]
    wanted = named.where("doc_id in (3, 4)").select("doc_id", "v")
    got = near_dups.shingles_of(rows, wanted, 4)
    assert sorted((r.v, len(r.set)) for r in got.collect()) == sorted((r.v, 16) for r in wanted.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")  # texts end below the join


def test_many_near_copies_are_one_component(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(100)] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, near_dups.near_components(frame(spark, rows), 4, 85).collect())) == sorted(brute_components(rows, 4, 85))
    assert near_dups.near_components(frame(spark, rows).limit(0)).count() == 0


def test_comparisons_grow_with_the_number_of_near_copies(spark, monkeypatch):
    compared = []
    verified = near_dups.verified

    def counted(pairs, *rest):
        compared[-1] += pairs.count()
        return verified(pairs, *rest)

    monkeypatch.setattr(near_dups, "verified", counted)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    for n in (200, 800):
        rows = []
        for i in range(n):
            w = list(base)
            for _ in range(2):
                w[rng.randrange(100)] = f"new{rng.randint(0, 10**6)}"
            rows.append((i, " ".join(w)))
        compared.append(0)
        got = near_dups.near_components(frame(spark, rows), 4, 85).collect()
        if n == 200:
            assert sorted(map(tuple, got)) == sorted(brute_components(rows, 4, 85))
    assert compared[0] < 5 * 200 and compared[1] < 5 * 800


def test_what_comparisons_move_is_bounded(spark, monkeypatch):
    moved, made = [], []
    verified, shingles_of = near_dups.verified, near_dups.shingles_of

    def counted(pairs, *rest):
        moved.append(pairs.count())
        return verified(pairs, *rest)

    def counted_sets(docs, wanted, k):
        made.append(wanted.count())
        return shingles_of(docs, wanted, k)

    monkeypatch.setattr(near_dups, "verified", counted)
    monkeypatch.setattr(near_dups, "shingles_of", counted_sets)
    monkeypatch.setattr(near_dups, "ROOM", 1, raising=False)
    rows = []
    for g in range(30):
        base = [f"w{g}x{i}" for i in range(40)]
        for c in range(12):
            rows.append((len(rows), " ".join([*base, f"copy{c}"])))
    rows += [(1000 + i, " ".join(f"z{j}" for j in range(i, i + 40))) for i in range(3)]
    got = near_dups.near_components(frame(spark, rows), 4, 85).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 4, 85))
    # All pairs of twelve copies are 1,980, which were compared at once, with all 363 sets.
    assert sum(moved) < 500 and max(moved) < 200 and max(made) < 300


def brute_words(rows, window):
    places, out = {}, []
    for n, (_, t) in enumerate(rows):
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), []).append((n, i))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for n, i in at:
                gone[n].update(range(i, i + window))
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().split()
        out.append((i, len(w), len(gone[n]), sha(b" ".join(x for p, x in enumerate(w) if p not in gone[n]))))
    return out


def brute_bytes(rows, window):
    first, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0))
    done = set()
    for n in order:
        if rows[n] in done:
            continue
        done.add(rows[n])
        b = (rows[n][1] or "").encode()
        cut = gone.setdefault(rows[n], set())
        for i in range(len(b) - window + 1):
            if first.setdefault(b[i : i + window], (n, i)) != (n, i):
                cut.update(range(i, i + window))
    out = []
    for row in rows:
        b, cut = (row[1] or "").encode(), gone[row]
        out.append((row[0], len(b), len(cut), sum(p - 1 not in cut for p in cut), sha(bytes(x for p, x in enumerate(b) if p not in cut))))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(n)) for n in (8, 12, 30, 60)]
    rows = []
    for i in range(50):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            cut = rng.randint(0, len(p) // 3)
            parts += [p[cut:], " ".join(word() for _ in range(rng.randint(0, 10)))]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, "ab " * 400), (63, "ab " * 90), (64, None), (65, ""), (66, "short"), (None, rows[5][1]), (67, shared[3])]
    return rows


def test_word_spans(spark):
    rows = passages(3)
    rows.append(rows[9])  # a repeated row is another place
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in automaton_dedup.dedup_words(frame(spark, rows), 10, 4).collect()]
    assert sorted(got, key=str) == sorted(brute_words(rows, 10), key=str)
    assert automaton_dedup.dedup_words(frame(spark, rows).limit(0)).count() == 0


def test_byte_spans(spark):
    rows = passages(4)
    rows.append(rows[9])  # a repeated row is the same place
    full = suffix_dedup.dedup_bytes(frame(spark, rows), 40, 12).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in full]
    assert sorted(got, key=str) == sorted(brute_bytes(rows, 40), key=str)
    for r in full:
        assert r.n_removed == sum(s.stop - s.start for s in r.spans) and (r.kept is not None) == bool(r.spans)
    assert suffix_dedup.dedup_bytes(frame(spark, rows).limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    for _ in range(4):
        head = text(300)
        rows = [(5, head + text(400)), (5, head + text(400)), (9, text(50) + head)]
        got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect())
        assert got == [(5, 0), (5, 300), (9, 300)]


def test_a_passage_in_many_surroundings(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    passage = words(50)
    rows = [(i, f"{words(rng.randint(0, 12))} {passage} {words(rng.randint(0, 12))}") for i in range(400)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in automaton_dedup.dedup_words(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_words(rows, 35))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_bytes(rows, 100))


def test_suffixes_are_sorted_column_by_column():
    import numpy as np

    rng = np.random.default_rng(2)
    matrix = rng.integers(0, 3, (12, 200)).astype(np.uint16)
    order, common = np.arange(200), np.zeros(200, np.uint8)
    for c in range(11, -1, -1):
        order, common = suffix_dedup.insert_column(matrix[c], order, common)
        rows = [tuple(matrix[c:, i]) for i in order]
        assert rows == sorted(rows)
        for i in range(1, 200):
            n = next((k for k, (x, y) in enumerate(zip(rows[i - 1], rows[i], strict=True)) if x != y), 12 - c)
            assert common[i] == n


def test_automaton_counts_places():
    rng = random.Random(6)
    texts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    automaton = automaton_dedup.SuffixAutomaton()
    for t in texts:
        automaton.add(t, 1)
    automaton.count()
    for t in texts:
        want = [e for e in range(4, len(t) + 1) if sum(t[e - 4 : e] == u[i : i + 4] for u in texts for i in range(len(u) - 3)) > 1]
        assert automaton.repeated_ends(t, 4) == want


def test_every_window_has_an_anchor_of_its_own_content():
    import numpy as np

    shape = suffix_dedup.byte_shape(40, 12)
    rng = np.random.default_rng(3)
    a, b = rng.integers(97, 100, 300).astype(np.uint8), rng.integers(97, 100, 55).astype(np.uint8)
    joined = np.concatenate([a, b, a])
    at = anchors.places(shape.gram_hashes(joined), np.array([300, 355, 655]), shape)
    assert {p - 355 for p in at if p >= 355} == {p for p in at if p < 300}
    for start in [*range(261), *range(300, 316)]:
        assert any(start <= p <= start + 28 for p in at)
