"""Periodic passages, short benchmark items, short marks, very long words,
wordless rows without an id: cases that a limit used to drop."""

import random

import numpy as np
import public_tokenizers
import pytest
from restated import repeats, segmentations
from test_operators import prose

from docsift.llm import bagminhash, decontaminate, langid, queries, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def lattice():
    return langid.Lattice(langid.read_pieces(public_tokenizers.path(queries.PIECE_VOCABULARY)))


def test_periodic_passages_are_found_whole(spark):
    rng = random.Random(7)
    docs = []
    for period in [1, 1, 2, 3, 5, 8, 13, 20, 34, *range(1, 35, 3)]:
        cycle = prose(rng, period).split()
        for _ in range(2):  # other lengths and phases
            shift, n = rng.randrange(period), rng.randint(60, 170)
            part = (cycle * (n // period + 2))[shift : shift + n]
            docs.append((len(docs), " ".join([prose(rng, rng.randint(0, 30)), *part, prose(rng, rng.randint(0, 30))])))
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    words = lambda spans: {p for s in spans for p in range(s["start"], s["stop"])}
    want = repeats(docs)
    assert {i: (words(r.repeated), words(r.removed)) for i, r in got.items()} == want and len(want) > 30


def test_items_under_five_words(spark):
    docs = [(1, "Say: a B, c d e!"), (2, "a c b"), (3, "b c"), (4, None), (5, "a b"), (6, "")]
    items = [(10, "a b"), (11, "b C d e"), (12, "c"), (13, "???"), (14, None), (15, "b c d e f")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.containment) for r in decontaminate.benchmark_leaks(d, b).collect()}
    assert got == {(1, 10, 1.0), (5, 10, 1.0), (1, 11, 1.0), (1, 12, 1.0), (2, 12, 1.0), (3, 12, 1.0)}
    assert {r.doc_id for r in decontaminate.drop_leaks(d, b).collect()} == {4, 6}


def test_short_marks(spark):
    rng = random.Random(3)
    pool = prose(rng, 60).split()
    some = lambda: " ".join(rng.choices(pool, k=30))
    docs = [(i, f"{some()} {rng.choice(('kys', 'K1S')) if i % 2 else 'kysten'} {some()}") for i in range(400)]
    labels = [(i, i % 2) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, label int"))
    assert "kys" + toxicity.END in lexicon.entries
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(d, lexicon).collect()}
    assert all(got[i] for i, t in docs if " kys " in t) and not any(got[i] for i, t in docs if "kysten" in t)


def test_long_words_over_all_segmentations(lattice):
    prob = np.random.default_rng(4).dirichlet(np.full(lattice.size, 0.3), 3).T
    for word in ("ka" * 30, "straße" * 12, "x" * 70):
        word = langid.START + word
        by_piece = [{p: prob[i, x] for p, i in lattice.piece.items()} for x in range(3)]
        table = np.zeros((3, len(word) + 1))
        table[:, 0] = 1
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 40), end):
                for x in range(3):
                    table[x, end] += table[x, start] * by_piece[x].get(word[start:end], 0)
            if word[end - 1] not in lattice.piece:
                table[:, end] += table[:, end - 1] * prob[lattice.unknown]
        assert np.allclose(lattice.long_log_probability(word, prob), np.log(table[:, -1]))
    short = langid.START + "kalo"
    assert np.isclose(np.exp(lattice.long_log_probability(short, prob))[0], segmentations(short, {p: prob[i, 0] for p, i in lattice.piece.items()}))


def test_scorer_takes_long_runs_whole(lattice):
    prob = np.random.default_rng(5).dirichlet(np.full(lattice.size, 0.3), 2).T
    model = langid.Model("k", list(lattice.piece), ["a", "b"], prob)
    run = "kalomi" * 10
    scorer = langid.Scorer(model)
    scorer._learn({run, "ka", "lo"})
    assert np.allclose(scorer.value[scorer.row[run]], lattice.long_log_probability(langid.START + run, prob))
    assert np.allclose(scorer.value[scorer.row["ka"]], lattice.long_log_probability(langid.START + "ka", prob))


def test_wordless_rows_without_id_stay(spark):
    rows = [(None, None), (None, " "), (None, ""), (None, ""), (1, None), (1, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = bagminhash.drop_near_duplicates(d).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", " "), ("1", "None"), ("None", ""), ("None", " "), ("None", "None")]
