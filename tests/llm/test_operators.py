"""The operators against plain restatements, their SQL, other libraries or
held-out labels."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from restated import bag, greedy, leaks, near_classes, repeats, segmentations, similarity
from conftest import SF_MID, SF_SMALL
from oracle_check import digest, duck
from pyspark.sql import functions as F

from docsift.llm import bagminhash, bpe, chat_trees, decontaminate, langid, line_rules, quality, queries, suffix_dedup, toxicity, wordpiece

SYLLABLES = "ka lo mi tu re so na vi pe du".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(2, 5))) for _ in range(n))


def edited(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_MID)
    cur = duck(SF_MID).execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(cols, cur.fetchall())


# 1 ------------------------------------------------------------------------
def test_registers_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for weights in (np.ones(300, int), rng.integers(1, 40, 300)):
        ids = rng.integers(0, 2**63, 300).astype(np.uint64)
        a = (ids[:260], weights[:260])
        b = (ids[60:], np.maximum(1, weights[60:] // 2))
        wa, wb = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
        keys = wa.keys() | wb.keys()
        true = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
        sig = bagminhash.signatures([a, b], 4096)
        assert abs((sig[0] == sig[1]).mean() - true) < 5 * (true * (1 - true) / 4096) ** 0.5


def test_signature_does_not_depend_on_the_batch():
    rng = random.Random(1)
    bags = [bagminhash.bag(prose(rng, n)) for n in (1, 3, 40, 700)] + [bagminhash.bag("so " * 900)]
    together = bagminhash.signatures(bags)
    for i, b in enumerate(bags):
        assert (bagminhash.signatures([b]) == together[i]).all()


def test_near_classes_equal_all_pairs(spark):
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [base] * 6 + [edited(rng, base, rng.choice((0.005, 0.01, 0.02, 0.03, 0.06))) for _ in range(150)]
    texts += [" ".join(base.split()[:k]) for k in range(70, 120, 3)]
    texts += [prose(rng, rng.randint(1, 60)) for _ in range(60)] + ["so so so so so so so " * 3, "so " * 22, "so " * 200, "ka lo", "ka  lo"]
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    got = bagminhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = near_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in want.items()}
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_near_classes_on_documents(spark, small):
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op1_bagminhash_near_dedup"](spark, SF_SMALL).collect()}
    assert got == {i: c for (i, _), c in near_classes(small).items()}


# 2 ------------------------------------------------------------------------
def test_branches_are_ranked_and_round_trip(spark):
    hard = "a\\<|im_end|>\n<|im_start|>user</s>[INST] \\\\<\\|x [/INST]\\"
    rows = [
        (1, 1, None, "system", hard, 0.0),
        (1, 2, 1, "user", "q", 1.0),
        (1, 3, 2, "assistant", hard, 5.0),
        (1, 4, 2, "assistant", "worse", 1.0),
        (1, 5, 4, "user<|im_sep|>", "late", 1.0),
        (1, 6, 99, "user", "orphan", 0.5),
        (2, 1, 2, "user", "cycle", 9.0),
        (2, 2, 1, "user", "cycle", 9.0),
        (3, 1, None, None, None, None),
        (3, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    out = chat_trees.format_branches(df, branches=3)
    out = out.withColumn("turns", chat_trees.read_turns(F.col("formatted"))).withColumn("learned", chat_trees.learned_text(F.col("formatted"), F.col("loss_spans")))
    got = {(r.tree_id, r.branch): ([(t.role, t.text) for t in r.turns], r.learned) for r in out.collect()}
    head = [("system", hard), ("user", "q")]
    assert got == {
        (1, 1): ([*head, ("assistant", hard)], hard),
        (1, 2): ([*head, ("assistant", "worse"), ("user<|im_sep|>", "late")], "worse"),
        (1, 3): ([("user", "orphan")], ""),
        (3, 1): ([("", "")], ""),
    }


def test_long_chain(spark):
    rows = [(7, i, i - 1 if i else None, "assistant", f"t{i}", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    got = chat_trees.format_branches(df).select(chat_trees.read_turns(F.col("formatted"))["text"].alias("t")).first().t
    assert got == [f"t{i}" for i in range(300)]


# 3 ------------------------------------------------------------------------
def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((4, 5, 9, 20, 40, 90, 300))]
    docs = []
    for i, t in items:
        for share in (0, 0.01, 0.03, 0.08):
            inside = edited(rng, t, share).upper().replace(" ", ", ")
            docs.append((len(docs), f"{prose(rng, 400)} {inside}. {prose(rng, 400)}"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(d, b).collect()}
    assert got == leaks(docs, items) and len(got) > 10


# 4 ------------------------------------------------------------------------
def test_repeats_equal_all_windows(spark):
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (50, 51, 75, 160)]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 80))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            w = p.split()
            cut = rng.choice((0, 0, 0, 7, 30))
            parts += [" ".join(w[cut:] if rng.random() < 0.5 else w[: len(w) - cut]), prose(rng, rng.randint(0, 40))]
        docs.append((i, "\n ".join(parts)))
    docs += [(100 + i, passages[3] + " " + passages[3]) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in suffix_dedup.repeated_passages(df).collect():
        at = lambda spans: {w for s in spans for w in range(s.start, s.stop)}
        got[r.doc_id] = (at(r.repeated), at(r.removed))
        assert (r.n_repeated, r.n_removed) == tuple(map(len, got[r.doc_id]))
    want = repeats(docs)
    assert got == want and len(got) > 30
    kept = {r.doc_id: r.text.split() for r in suffix_dedup.drop_repeats(df).collect()}
    for i, t in docs:
        left = [w for p, w in enumerate(t.split()) if p not in want.get(i, ((), ()))[1]]
        assert kept.get(i, []) == left


def test_repeats_across_many_ranges(spark):
    rng = random.Random(8)
    common = prose(rng, 120)
    docs = [(i, f"{prose(rng, 30)} {common} {prose(rng, 30)}") for i in range(200)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {i: tuple(map(len, x)) for i, x in repeats(docs).items()}
    assert {r.doc_id: (r.n_repeated, r.n_removed) for r in got} == want and min(want.values())[0] >= 120


# 5, 8, 9 --------------------------------------------------------------------
def test_held_out_scores(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, column, least in (("op5_quality_ftrl", "quality", 0.98), ("op8_toxicity_lexicon", "toxic", 0.97)):
        out = queries.QUERIES[name](spark, sf).join(labels, "doc_id").filter("held_out")
        assert out.select(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0] >= least
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.QUERIES["op9_language_unigrams"](spark, sf).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL")
    assert out.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.99


def test_toxic_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idio": 5.0, "scum": 5.0}, ["idiot proof"])
    a = lexicon.automaton()
    assert toxicity.weighed(toxicity.fold("You 1D10T"), a) > 0
    assert toxicity.weighed(toxicity.fold("ѕсum"), a) > 0  # two Cyrillic letters
    assert toxicity.weighed(toxicity.fold("ｓｃｕｍ"), a) > 0
    assert toxicity.weighed(toxicity.fold("an idiot proof plan"), a) == 0
    assert toxicity.weighed(toxicity.fold("periscum"), a) == 0


def test_ftrl_dot_product_is_sparse():
    i, v = quality.features("a b a")
    assert len(i) == 4 and abs((v**2).sum() - 1) < 1e-9
    assert len(quality.features(None)[0]) == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "c"]
    lattice = langid.Lattice(pieces)
    rng = np.random.default_rng(2)
    prob = rng.random((lattice.size, 2))
    words = ["▁abab", "▁", "▁cab", "▁aaaaaaa", "▁b"]
    got = np.exp(lattice.log_probabilities(words, prob))
    for w, word in enumerate(words):
        for x in range(2):
            p = {piece: prob[i, x] for piece, i in lattice.piece.items()}
            assert got[w, x] == pytest.approx(segmentations(word, p))
    uses = lattice.expected(words, np.ones((5, 2)), prob)
    assert (uses @ np.ones(2))[lattice.piece["c"]] == pytest.approx(2)  # in every segmentation of ▁cab


# 6 ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(queries.BYTE_VOCABULARY))


def test_bpe_equals_tiktoken(ranks, small):
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(9)
    alphabet = "aAzéß中文ж🙂ñ'’ \t\n\r\x0b\x1c\x85\xa0   09²½_-.!'st"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [chr(c) + " a" + chr(c) + "1 " for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for t in [*texts, *(t for _, t in small[:60])]:
        ids = enc.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), t
        assert enc.decode(ids) == t.encode()


def test_bpe_appends_and_edits(ranks):
    table_ranks = bpe.Ranks(ranks)
    rng = random.Random(10)
    letters = "thenaio rst"
    for _ in range(60):
        data = "".join(rng.choices(letters, k=200)).encode()
        table = bpe.PrefixTable(table_ranks, data[:50])
        table.append(data[50:])
        assert table.tokens() == bpe.PrefixTable(table_ranks, data).tokens()
        a = rng.randint(0, 150)
        b = a + rng.randint(0, 10)
        new = "".join(rng.choices(letters, k=rng.randint(0, 8))).encode()
        made = table.replace(a, b, new)
        assert table.data == data[:a] + new + data[b:]
        assert table.last == bpe.PrefixTable(table_ranks, table.data).last
        assert made <= len(table.data) - a


def test_bpe_query(spark, ranks, small):
    enc = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in queries.QUERIES["op6_byte_bpe"](spark, SF_SMALL).collect()}
    for i, t in small:
        ids = enc.encode(t)
        want = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


# 10 -----------------------------------------------------------------------
def test_counts_equal_greedy(spark, small):
    pieces = langid.read_pieces(public_tokenizers.path(queries.PIECE_VOCABULARY))
    first, later = {p for p in pieces if p.startswith("▁")}, {p for p in pieces if not p.startswith("▁")}
    got = {r.doc_id: r for r in queries.QUERIES["op10_token_counts"](spark, SF_SMALL).collect()}
    for i, t in small[:80]:
        n = [greedy("▁" + w, first, later) for w in t.split()]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(n), sum(x or 1 for x in n), n.count(None))
    rng = random.Random(11)
    vocabulary = ["▁a", "▁ab", "a", "b", "abc", "bcd", "▁abcdx", "cd", "▁"]
    automaton = wordpiece.Automaton(vocabulary)
    first, later = {p for p in vocabulary if p[0] == "▁"}, {p for p in vocabulary if p[0] != "▁"}
    for _ in range(3000):
        word = "▁" + "".join(rng.choices("abcdx", k=rng.randint(1, 9)))
        assert automaton.count(word) == greedy(word, first, later), word


def test_helpers():
    assert similarity(bag("a b"), bag("a b")) == 1
    assert base64.b64decode(b"YQ==") == b"a"
    assert line_rules.MIN_WORDS == 10
