import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tessella.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
TEXTS = ["", None, " ", "   ", "a  b", "a   b", "a  ", "a\n \nb", "x \n y\n\n z  \n", "don't can't ''s 's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "naïve Straße 12345 ½Ⅷ² \x1c\x85\xa0  end ", "日本語 текст 🙂🙂 ​﻿", "\t\t x", "of%%% athe*** | a"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_matches_merges_by_rank(reference):
    own = bpe.ByteBpe(RANKS, P.PATTERN)
    rng = random.Random(5)
    alphabets = ["ab", "the and ing", " \n\tab", "aeiouéßñ .,!#%", "0123456789abcdef", "日本語текст🙂 "]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 300))) for _ in range(1500)]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text.encode()


def test_documents(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y"), (3, "   ", "y")], "doc_id long, text string, ids string")
    rows = bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            ids = reference.encode_ordinary(TEXTS[r.doc_id] or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0
