"""Mixing and quality rules on rows with every awkward case; the queries' SQL covers ordinary ones."""

import pytest

from tessella.llm import mixing, quality


def test_mix_edges(spark):
    rows = [(i, "w " * (i % 9), ["a", "b", None][i % 3], "x") for i in range(90)] + [(200, None, "c", "x"), (201, "", "c", "x"), (None, "one two", "a", "x"), (5, "w " * 5, None, "x"), (300, "long " * 4000, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in ("a", "b", "c", None)}
    for s in total:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == total[s] and r.taken in (0, r.size, 2 * r.size) for r in own)
        assert own[0].target <= 2 * total[s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-9
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(total.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_repeated_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 5 else "b", i) for i in range(40)], "doc_id long, text string, source string, copies_ long")
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.where("source = 'a'").groupBy("doc_id").count().collect()} == {i: 2 for i in range(5)}
    assert out.count() * 10 == sum(r.taken for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("name", ["null ids, own texts", "null ids, one text", "repeated ids"])
def test_a_mix_of_rows_without_ids_of_their_own(spark, name):
    """Two sources of 300 documents of 10 words each, of weights 3 and 1: 6000 and 3000 words are wanted, the first source twice."""
    text = lambda i: "w " * 9 + (str(i) if name != "null ids, one text" else "w")
    rows = [((i % 20) if name == "repeated ids" else None, text(i), "a" if i < 300 else "b", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, last_size long")
    for taken in (
        {r.source: r.taken for r in mixing.mix(docs).groupBy("source").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()},
        {r.source: 10 * r["count"] for r in mixing.repeat_documents(docs).groupBy("source").count().collect()},
    ):
        assert taken["a"] == 6000 and abs(taken["b"] - 3000) < 500


def test_quality_edges(spark):
    good = "\n".join(" ".join(f"{w}{i}{j}" for j in range(12)) for i, w in enumerate(["some", "words", "that", "differ", "mostly", "here"]))
    rows = [(i, good.replace("some", f"some{i}"), "en", "s", 0) for i in range(30)] + [
        (100, None, None, None, 0), (101, "", "en", "s", 0), (102, "a b c " * 60, "en", "s", 0), (103, good + " ### $$$ %%% &&& ||| <<< >>>" * 9, "en", "s", 0), (104, good.upper(), "en", "s", 0), (105, good, "en", None, 0), (None, good, "en", "s", 0), (106, "ß\t" * 70000, "de", "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m long")
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in [*range(30), 105, None]) and not any(got[i].kept for i in (100, 101, 102, 103, 104, 106))
    assert (got[102].n_words, got[102].n_repeat_words, got[102].base_failed) == (180, 180, True)
    assert (got[103].base_failed, got[104].base_failed, got[106].n_repeat_words) == (False, False, 70000)
    kept = quality.keep_good(docs.drop("m"))
    assert kept.columns == docs.drop("m").columns and kept.count() == 32
    assert quality.quality_report(docs.drop("m").limit(0)).count() == 0


def test_repeats_count_the_first_and_overlap(spark):
    cases = {"a b c x a b c": 6, "a a a a": 4, "a b c d": 0, "a b": 0, "a b c a b": 0, "a b c d a b c d": 8}
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(cases)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality.quality_report(docs).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
