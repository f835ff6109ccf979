"""Packing: every id in one piece, windows within the capacity, little padding; ids as the tokenizer gives them."""

import json
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docmill.llm import packing
from docmill.llm.queries import BPE, vocabulary

ODD = [None, "", " ", "\n\n\n", "it's they'RE 've", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "1234567 89",
       "日本語のテキスト", "naïve café x", "🙂🙃 emoji", "\x00\x01\x7f", "x" * 5000, "a  b   c\t\td \r\n e", "½ ² Ⅷ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(BPE))


def test_ids_equal_the_tokenizers_library(spark, small, tokenizer):
    encoding = packing.byte_level_encoding(vocabulary())
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += [r.html for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    rng = random.Random(1)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x2000), 32, 10])) for _ in range(80))
              for _ in range(500)]
    for text in [*texts, *ODD[1:]]:
        assert encoding.encode(text or "", allowed_special="all") == tokenizer.encode(
            text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_differencing_parts_everything(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 400) for _ in range(rng.randrange(1, 60))]
    for k in (1, 2, 3, 17):
        parts = packing.differenced(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) <= k
    parts = packing.windows(sizes, 512)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 512 for p in parts)


def test_differencing_balances():
    sums = [sum(p) for p in [[[8, 7, 6, 5, 4][i] for i in part] for part in packing.differenced([8, 7, 6, 5, 4], 2)]]
    assert sorted(sums) == [14, 16]  # the textbook case
    assert packing.windows([600, 600, 600], 1024) != [] and len(packing.windows([600, 600, 600], 1024)) == 3
    assert packing.windows([], 1024) == []


def check(rows, texts, tokenizer, capacity=1024):
    """texts: list of (doc_id, text). Returns the share of padding."""
    ids = defaultdict(list)
    for doc, text in texts:
        ids[doc].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for doc, versions in ids.items():
        pieces = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens) for r in by_doc[doc])
        want = [x for v in versions for x in v]
        assert sorted(x for _, p, _ in pieces for x in p) == sorted(want)
        if len(versions) == 1:
            assert [x for _, p, _ in pieces for x in p] == want
            at = 0
            for start, p, total in pieces:
                assert start == at and total == len(want)
                at += len(p)
    assert set(by_doc) == set(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return 1 - sum(r.length for r in rows) / (capacity * len(sequences))


def test_all_documents(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    padding = check(packing.pack(docs, vocabulary()).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()],
                    tokenizer)
    assert padding < 0.02


def test_odd_rows_and_small_blocks(spark, tokenizer):
    texts = [*enumerate(ODD), (None, "no id"), (3, "repeated row"), (3, "repeated row"), (99, "word " * 30_000)]
    docs = spark.createDataFrame([(d, t, 7, 8) for d, t in texts], "doc_id long, text string, ids int, start int")
    check(packing.pack(docs, vocabulary(), capacity=64, block_windows=2).collect(), texts, tokenizer, 64)
    check(packing.pack(docs.repartition(9), vocabulary()).collect(), texts, tokenizer)
    assert packing.pack(docs.limit(0), vocabulary()).collect() == []


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\xa0", " \n"])
def test_very_long_white_space(spark, tokenizer, blank):
    texts = [(1, "a" + blank * (2_000_000 // len(blank)) + "b c"), (2, blank * 1_000_000), (3, "x " + blank * 99_999 + "y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    check(packing.pack(docs, vocabulary()).collect(), texts, tokenizer)


def test_other_vocabularies_are_refused():
    model = json.loads(vocabulary())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}},
                   {"pre_tokenizer": {**model["pre_tokenizer"], "add_prefix_space": True}},
                   {"model": {**model["model"], "merges": model["model"]["merges"][::-1]}}):
        with pytest.raises(ValueError, match="byte-level"):
            packing.byte_level_encoding(json.dumps({**model, **change}))


def test_the_vocabulary_is_not_copied():
    assert not list(Path(__file__).resolve().parents[2].rglob(BPE))
