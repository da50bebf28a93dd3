"""Ids of texts from remembered and jointly encoded chunks are those of the tokenizer on whole texts."""

from __future__ import annotations

import random

import pyarrow as pa
from tokenizers import Tokenizer

from cadenza.llm import neardup, packing, tokens
from cadenza.llm.tokens import ChunkTokenizer, default_path

ODD = ["Straße", "İstanbul", "ΣΑΣ.", "ﬁn", "éa", "ǅ", "K", "中文字", "a1", "don't", "...", "x&&&", "ÉCOLE!", "ʰa", "\U0001e030b", "ªº", "अआ", "क्ष"]


def test_runs_of_letters_are_encoded_jointly():
    """Words whose letters are no single pre-token stand among plain ones, more than fill one joined text."""
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefgéüñßж", k=rng.randint(1, 9))) for _ in range(900)]
    texts = [" ".join(rng.choices(plain + ODD, k=300)) for _ in range(5)] + [" ".join(plain)]
    own, whole = ChunkTokenizer(default_path()), Tokenizer.from_file(default_path())
    joined, encode = [], own._encode_letters
    own._encode_letters = lambda words: joined.append(len(words)) or encode(words)
    want = [b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.ids(texts) == want and own.ids(texts) == want and sum(joined) > 500
    few = [w for w in set(plain) if w.isalpha()]
    calls, plain_encode = [], own._encode
    own._encode = lambda words: calls.append(len(words)) or plain_encode(words)
    assert own._encode_letters(few) == plain_encode(few) and not calls


def test_later_stages_do_not_keep_what_packing_remembered(spark):
    """One task after another in the same worker: after the signatures no tokenizer is held."""
    docs = spark.createDataFrame([(k, f"some words of document {k}") for k in range(4)], "doc_id long, text string").coalesce(1)

    def held(batches):
        for batch in batches:
            yield batch.slice(0, 1).set_column(0, "doc_id", pa.array([len(tokens._known)], pa.int64()))

    count = lambda df: df.coalesce(1).mapInArrow(held, "doc_id long, text string").first().doc_id
    packing.tokenise(docs).count()
    assert count(docs) == 1
    neardup.signatures(docs, "doc_id", "text", 5, 4, 8).count()
    assert count(docs) == 0
