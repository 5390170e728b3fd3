import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import token_store as S

DEFINITION = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()


def test_crc_of_parts():
    rng = random.Random(3)
    whole = [[rng.randbytes(rng.randint(1, 5000)) for _ in range(rng.randint(1, 6))] for _ in range(50)]
    parts = [p for w in whole for p in w]
    offsets = np.cumsum([0, *map(len, whole)])
    got = S.joined_crc32(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), offsets)
    assert got.tolist() == [zlib.crc32(b"".join(w)) for w in whole]


def test_cut_points_cover_and_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50000, 40000).astype("<u2")
    ends = S.cut_points(ids, S._table())
    assert ends[-1] == len(ids) and (np.diff(ends) > 0).all() and np.diff(ends).max() <= S.LONGEST
    moved = S.cut_points(np.concatenate([ids[:7], ids]), S._table()) - 7
    assert len(set(ends) & set(moved)) > 0.9 * len(ends)
    assert S.cut_points(np.zeros(20000, "<u2"), S._table())[-1] == 20000


def test_round_trip(spark, tmp_path):
    rng = random.Random(4)
    passage = " ".join(rng.choices(["the", "ing", "Straße", "on\n", "x  y"], k=900))
    texts = [None, "", "a", "  \n ", "it's <|endoftext|> ½ 日本", passage, passage + " tail", "head " + passage, passage]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5, passage, "t"), (None, "no id", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digests string")
    path = S.write_store(docs, DEFINITION, P.PATTERN, 2, path=f"file://{tmp_path}/store")
    assert path == f"file://{tmp_path}/store"
    store = S.open_store(spark, path)
    library = Tokenizer.from_str(DEFINITION)
    library.encode_special_tokens = True
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, S.read_checksums(store).collect()), key=lambda r: r[1])
    assert got == want
    assert S.verify_manifest(store)
    digests = [bytes(r.digest) for r in store["chunks"].collect()]
    assert len(digests) == len(set(digests))
    back = {r.start: np.frombuffer(r.ids, "<u2").astype("<u4").tobytes() for r in S.read_ids(store).collect()}
    assert all(zlib.crc32(back[s]) == c for _, s, _, c in want)
    broken = store | {"recipes": store["recipes"].withColumn("root", store["recipes"].root.substr(1, 3))}
    assert not S.verify_manifest(broken)
    with pytest.raises(Exception, match="don't give"):
        S.read_checksums(broken).collect()
    fewer = store | {"recipes": store["recipes"].where("start > 0")}
    with pytest.raises(Exception, match="don't give"):
        S.read_checksums(fewer).collect()
    damaged = store | {"chunks": store["chunks"].withColumn("data", F.expr("overlay(data placing X'00' from 1)"))}
    with pytest.raises(Exception, match="damaged"):
        S.read_checksums(damaged).collect()
    assert S.read_checksums(S.open_store(spark, S.write_store(docs.limit(0), DEFINITION, P.PATTERN, 2))).count() == 0


def test_added_tokens_are_one_id(spark, tmp_path):
    from tessella.llm import queries

    texts = ["a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext|>", " <|endoftext| >", "plain text", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library, start = Tokenizer.from_str(DEFINITION), 0
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for r, t in zip(sorted(queries.op6_token_store(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id), texts, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
