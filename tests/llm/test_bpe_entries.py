"""Entries of prefixes that short pieces share."""

import random

import public_tokenizers
import pytest

from docsift.llm import bpe, queries


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(bpe.read_ranks(public_tokenizers.path(queries.BYTE_VOCABULARY)))


def test_entries_equal_the_table(ranks):
    rng = random.Random(3)
    pieces = ["".join(rng.choices("thenaio rst\té中🙂", k=rng.randint(1, 90))).encode() for _ in range(2000)]
    pieces += [b" " * n for n in (1, 40, 64, 65, 300)] + [b"a" * n for n in (63, 64, 65, 1000)]
    for p in pieces:
        assert ranks.tokens(p) == bpe.PrefixTable(ranks, p).tokens(), p
    assert ranks.tokens(b"") == []


def test_few_entries_are_made(ranks):
    ranks.ends.clear()
    ranks.tokens(b" thentienanonlyonorresh")
    assert 0 < len(ranks.ends) < 20  # of 23 prefixes
    before = len(ranks.ends)
    ranks.tokens(b" thentienanonlyonorresh" + b"q")
    assert len(ranks.ends) <= before + 3


def test_kept_entries_are_bounded(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE_SIZE", 10)
    rng = random.Random(4)
    for _ in range(300):
        p = "".join(rng.choices("thenaiorst", k=12)).encode()
        assert ranks.tokens(p) == bpe.PrefixTable(ranks, p).tokens()
        assert len(ranks.ends) <= 22
