"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names, for every operator and pipeline stage."""

import random

import public_tokenizers
import pytest
from test_operators import prose

from docsift.llm import bagminhash, bpe, chat_trees, decontaminate, langid, line_rules, quality, queries, suffix_dedup, toxicity, wordpiece

KIND = "doc_id long, text string, lang string, source string, n_chars long, k1 string, tid int, row string, key long, hub int, removed int, label int"


def rows():
    rng = random.Random(12)
    long = prose(rng, 60_000)
    line = "the same line in every text of this host"
    texts = [None, "", "  \n\t ", "one", "!!! ???", "a b c d", long, long, " ".join(["so"] * 3000), "x" * 200_000]
    texts += [f"{line}\n{prose(rng, 40)}\n{line}" for _ in range(30)]
    texts += [None, texts[12], texts[12]]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, ("en", "de", None)[i % 3], (None, "h")[i % 2], len(t or ""), "k", 1, "r", 2, 3, 4, 5))
    out += [out[12], out[12], out[0], (None, texts[13], "en", "h", 1, None, None, None, None, None, None, None), (None, None, *([None] * 10))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND)


@pytest.fixture(scope="module")
def labels(spark):
    data = [(i, i % 2, (i + 1) % 2) for i in range(45)] + [(3, 0, 0), (None, 1, 1), (4, None, None)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


PIECES = public_tokenizers.path(queries.PIECE_VOCABULARY)
BYTES = public_tokenizers.path(queries.BYTE_VOCABULARY)


def operators(spark, docs, labels):
    bench = spark.createDataFrame([(1, "the same line in every text"), (1, "the same line in every text"), (2, None), (3, "a b"), (None, "")], "item_id long, text string")
    return {
        "near": lambda d: bagminhash.near_duplicate_classes(d),
        "leaks": lambda d: decontaminate.benchmark_leaks(d, bench),
        "no benchmark": lambda d: decontaminate.benchmark_leaks(d, bench.limit(0)),
        "repeats": lambda d: suffix_dedup.repeated_passages(d),
        "quality": lambda d: quality.quality_scores(d, labels),
        "bpe": lambda d: bpe.encode_texts(d, BYTES, public_tokenizers.PATTERN, ["doc_id"]),
        "lines": lambda d: line_rules.line_rules(d),
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels),
        "language": lambda d: langid.language_predictions(d, PIECES),
        "tokens": lambda d: wordpiece.token_counts(d, langid.read_pieces(PIECES)),
    }


def test_empty_tables(spark, docs, labels):
    for name, f in operators(spark, docs, labels.limit(0)).items():
        assert f(docs.limit(0)).count() == 0, name
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_trees.format_branches(chat_trees.as_replies(none)).count() == 0


def test_defined_results(spark, docs, labels):
    data = rows()
    got = {name: f(docs).collect() for name, f in operators(spark, docs, labels).items()}
    for name in ("near", "quality", "bpe", "lines", "toxicity", "language", "tokens"):
        assert len(got[name]) == len(data), name
    near = {}
    for r in got["near"]:
        near.setdefault(r.doc_id, []).append((r.class_id, r.kept))
    assert near[7] == [(6, False)] and near[41] == [(12, False)] and near[12] == [(12, True)] * 3  # copies; repeated rows
    assert near[0] == [(0, True)] * 2 and near[40] == [(40, True)] and near[1] == [(1, True)]  # no words
    assert sorted(x[0] for x in near[None] if x[0] is not None) == [13]
    assert {(r.doc_id, r.item_id) for r in got["leaks"]} == {(i, 1) for i in [*range(10, 40), 41, 42, None]} | {(5, 3)}
    assert not got["no benchmark"]
    repeated = {r.doc_id: r for r in got["repeats"]}
    assert repeated[6].n_removed == 0 and repeated[7].n_removed == 60_000 and 0 not in repeated and 8 not in repeated
    assert {r.doc_id: r.lang_pred for r in got["language"] if r.doc_id in (0, 1, 2, 4)} == dict.fromkeys((0, 1, 2, 4), "und")
    assert all(0 <= r.score <= 1 for n in ("quality", "toxicity", "language") for r in got[n])
    assert all(len(r.ids) == 0 and r.decoded == b"" for r in got["bpe"] if r.doc_id in (0, 1))
    assert {r.doc_id: bytes(r.decoded).decode() for r in got["bpe"]}[9] == "x" * 200_000
    lines = {r.doc_id: r for r in got["lines"]}
    assert lines[0].base_failed and lines[0].n_words == 0 and lines[8].n_repeat_words == 3000 and not lines[8].kept
    assert lines[11].removed_share > 0 and lines[7].kept
    assert {r.doc_id: r.n_tokens for r in got["tokens"]}[0] == 0


def test_no_training_rows(spark, docs, labels):
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity_scores(docs, none).collect()} == {0}
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    no_lang = docs.filter("lang IS NULL AND lang = 'x'").unionByName(docs.limit(5).drop("lang").selectExpr(*[c if c != "lang" else "CAST(NULL AS STRING) AS lang" for c in docs.columns]))
    assert {r.lang_pred for r in langid.language_predictions(no_lang, PIECES).collect()} == {"und"}


def test_filters_keep_whole_rows(spark, docs):
    kept = bagminhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(12) == 1 and 41 not in ids and 7 not in ids and ids.count(0) == 1
    cut = suffix_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns
    by = {r.doc_id: r for r in cut.collect()}
    assert 7 not in by and by[6].text == rows()[6][1] and by[0].text is None and by[3].hub == 3
    found = langid.keep_identified(docs, PIECES)
    assert found.columns == docs.columns and not {0, 1, 2, 4} & {r.doc_id for r in found.collect()}
