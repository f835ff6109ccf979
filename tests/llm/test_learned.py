"""The learned operators: held-out accuracy, what they may learn from, and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from docmill.llm import language_id as L
from docmill.llm import quality_model as M
from docmill.llm import quality_rules as R
from docmill.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 1.0, 2) for d, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, score double, n_words int")


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, quality int, toxic int, text string")


def prose(rng, n):
    return " ".join(rng.choice(["plain", "words", "of", "the", "river", "and", "stone", "under", "hills"]) + rng.choice(["", "", ","])
                    for _ in range(n)).capitalize() + "."


def junk(rng, n):
    return " | ".join(rng.choice(["BUY", "NOW!!", "$$$", "###", "FREE!!"]) for _ in range(n))


def sample(seed=1, n=240):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        docs.append((i, (prose if good else junk)(rng, rng.randrange(60, 200)), "en"))
        labels.append((i, int(good), 0))
    return docs, labels


ODD = [(1000, None, None), (1001, "", "en"), (None, "no id at all", "en"), (None, None, None), (1002, "12 34 !?", "en"),
       (1003, "word " * 200_000, "en"), (1, "repeated id", "en"), (1004, " \n\t", None)]


def test_quality_model_learns_held_out_rows(spark):
    docs, labels = sample()
    rows = M.classify(docs_of(spark, docs + ODD), labels_of(spark, labels)).collect()
    assert len(rows) == len(docs + ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    truth = {d: q for d, q, _ in labels}
    unseen = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97


def test_quality_model_ignores_held_out_labels(spark):
    docs, labels = sample()
    flipped = [(d, 1 - q if held_out(d) else q, t) for d, q, t in labels]
    a, b = (M.train(docs_of(spark, docs), labels_of(spark, x)) for x in (labels, flipped))
    assert a.bias == b.bias and all((x[2] == y[2]).all() for x, y in zip(a.single, b.single))


def test_quality_model_without_teachers(spark):
    docs, labels = sample(n=30)
    d = docs_of(spark, docs + ODD)
    for none in ([], [(None, 1, 0), (2, None, 0), (3, 7, 0)]):
        assert {r.score for r in M.classify(d, labels_of(spark, none)).collect()} == {0.5}
    only = M.classify(d, labels_of(spark, [(d_, 1, 0) for d_, _, _ in labels])).collect()
    assert min(r.score for r in only) > 0.9
    assert M.classify(d.limit(0), labels_of(spark, labels)).collect() == []
    assert M.apply(d, labels_of(spark, labels)).schema == d.schema


def test_quality_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = M.fit(x[:3000], y[:3000])
    assert (1, 3) in [(i, j) for i, j, *_ in model.double]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


def test_quality_on_given_labels(spark):
    rows = QUERIES["op4_quality_classifier"](spark, MIDDLE).join(
        spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.95 and np.mean([1 - r.predicted for r in bad]) > 0.9


TEXTS = {"aa": "banana cabana ", "bb": "kitten mitten ", "cc": "über größe straße ", "dd": "где кто что "}


def languages(n=120):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(TEXTS))
        words = TEXTS[lang].split()
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))), lang))
    return out


def test_language_id_on_held_out_rows(spark):
    docs = languages()
    rows = L.identify(docs_of(spark, docs + ODD)).collect()
    assert len(rows) == len(docs + ODD)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    truth = {d: lang for d, _, lang in docs}
    assert all(r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth)
    by_text = {(d, t): None for d, t, _ in ODD}
    und = [r for r in rows if r.lang_pred == "und"]
    assert sorted((r.doc_id for r in und), key=repr) == sorted(
        (d for d, t in by_text if not any(c.isalpha() for c in t or "")), key=repr)
    assert all(r.score == 0 for r in und)


def test_language_id_ignores_held_out_languages(spark):
    docs = languages()
    other = [(d, t, "zz" if held_out(d) else lang) for d, t, lang in docs]
    a, b = (L.train(docs_of(spark, x)) for x in (docs, other))
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_language_id_with_few_languages(spark):
    one = [(d, t, "aa") for d, t, _ in languages(20)]
    assert {r.lang_pred for r in L.identify(docs_of(spark, one)).collect()} == {"aa"}
    none = [(d, t, None) for d, t, _ in languages(20)]
    assert {(r.lang_pred, r.score) for r in L.identify(docs_of(spark, none)).collect()} == {("und", 0.0)}
    assert L.identify(docs_of(spark, one).limit(0)).collect() == []


@pytest.mark.parametrize("n", [2, 4, 7, 8, 40])
def test_codewords_differ_in_many_bits(n):
    code = L.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert len(code) == n and min(apart) >= (1 if n == 2 else 2 if n < 5 else 5)


def test_decoding_survives_a_wrong_bit():
    code = L.codewords(7)
    model = L.OutputCodes(list("abcdefg"), code, np.zeros((L.BUCKETS, code.shape[1]), np.float32), None,
                          np.full(code.shape, 1 / code.shape[1], np.float32))
    for k in range(7):
        answer = 4 * code[k].copy()
        answer[:12] *= -1
        model.bias = answer
        assert model.losses(np.zeros((1, L.BUCKETS), np.float32)).argmin() == k


def test_languages_on_given_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op5_language_id"](spark, MIDDLE).collect() if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97


def brute_rules(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


TRICKY = ["a b c a b c", "a b c d", "x x x x x", "é\x0bü\x0cß z", "l1\nl1\n l1\n\n\n \nl1", "#*$%&|<>", "a a b a a b a a",
          "one two three " * 40 + " ".join(f"u{i}" for i in range(130)), " ".join(f"w{i % 37}" for i in range(60)),
          " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50))]


def test_rules_against_brute_force(spark):
    docs, labels = sample(n=90)
    rows = docs + ODD + [(2000 + i, t, "en") for i, t in enumerate(TRICKY)]
    got = R.judge(docs_of(spark, rows), labels_of(spark, labels)).collect()
    want = []
    for doc, text, _ in rows:
        n, *rest = brute_rules(text)
        want.append((doc, n, *rest, n < 50 or 100 * rest[-1] > 50 * n))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got), key=repr) == sorted(want, key=repr)
    assert all(not (r.kept and r.base_failed) for r in got)


def brute_ratios(docs, trusted):
    raw, target = np.zeros(R.BUCKETS), np.zeros(R.BUCKETS)
    for doc, text, _ in docs:
        words = (text or "").encode().split()
        hashes = [zlib.crc32(w) + 1 for w in words]
        grams = hashes + [(a * int(R.TURN) % 2**64) ^ b for a, b in zip(hashes, hashes[1:])]
        for g in grams:
            at = (g * int(R.MIX) % 2**64) >> 48
            raw[at] += 1
            target[at] += doc in trusted
    return np.log((target + 1) / (target.sum() + R.BUCKETS)) - np.log((raw + 1) / (raw.sum() + R.BUCKETS))


def test_ratios_count_all_documents(spark):
    docs, labels = sample(n=60)
    d, trusted = docs_of(spark, docs + ODD), R.trusted_ids(labels_of(spark, labels))
    half = {r.doc_id for r in trusted.where("half = 0").collect()}
    assert half and half < {x[0] for x in labels if x[1]}
    assert np.allclose(R.log_ratios(d.repartition(5), trusted), brute_ratios(docs + ODD, half))


def test_rules_take_junk_out_and_keep_prose(spark):
    docs, labels = sample(n=400)
    rng = random.Random(9)
    new = [(5000 + i, prose(rng, 150), "en") for i in range(40)] + [(6000 + i, junk(rng, 150), "en") for i in range(40)]
    got = {r.doc_id: r for r in R.judge(docs_of(spark, docs + new), labels_of(spark, labels)).collect()}
    rule = [r for r in got.values() if not r.base_failed]
    assert np.mean([got[d].kept for d, _, _ in new[:40] if not got[d].base_failed]) > 0.9
    assert not any(got[d].kept for d, _, _ in new[40:])
    assert len({r.kept for r in rule}) >= 1


def test_rules_without_trusted_documents(spark):
    docs, labels = sample(n=30)
    d = docs_of(spark, docs + ODD)
    for none in ([], [(x, 1, 1) for x, _, _ in labels], [(1, 1, 0), (1, 0, 0)]):
        assert all(r.kept == (not r.base_failed) for r in R.judge(d, labels_of(spark, none)).collect())
    assert R.judge(d.limit(0), labels_of(spark, labels)).collect() == []


def test_the_threshold_parts_trusted_from_bad():
    bins = [(-9, 0, 40), (-5, 0, 10), (-1, 20, 30), (0, 300, 20), (3, 680, 0)]
    assert R.best_edge(bins) == 0.0
    assert R.best_edge([(-20, 1, 0), *bins]) == R.best_edge([(-9, 1, 40), *bins[1:]]) == 0.0  # one trusted row among the junk
    assert R.best_edge([(-9, 0, 5), (4, 50, 0)]) == -8 * R.BIN and R.best_edge([(-9, 1, 5), (4, 49, 0)]) == -8 * R.BIN
    for one_side in ([], [(0, 5, 0)], [(0, 0, 5)]):
        assert R.best_edge(one_side) == -np.inf


def test_one_mislabelled_junk_row_does_not_keep_the_junk(spark):
    """Under 1,000 trusted rows: the worst of them would have been the threshold."""
    docs, labels = sample(n=400)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    new = [(5000 + i, " ".join(rng.choice(words) for _ in range(150)), "en") for i in range(60)]
    bad = [(d, 0, 0) for d, _, _ in new[:30]]
    for wrong in ([], [(new[30][0], 1, 0)], [(new[31][0], 1, 0)], [(new[32][0], 1, 0)]):
        got = {r.doc_id: r for r in R.judge(docs_of(spark, docs + new), labels_of(spark, labels + bad + wrong)).collect()}
        rule = [got[d] for d, _, _ in new[33:]]
        assert not any(r.base_failed for r in rule) and not any(r.kept for r in rule)
        good = [got[d] for d, q, t in labels if (q, t) == (1, 0) and not got[d].base_failed]
        assert np.mean([r.kept for r in good]) > 0.9


def test_both_halves_are_counted(spark):
    docs, labels = sample(n=60)
    d, trusted = docs_of(spark, docs + ODD), R.trusted_ids(labels_of(spark, labels))
    ids = {r.doc_id for r in trusted.collect()}
    raw, *targets = R.bucket_counts(d.repartition(5), trusted)
    assert all((a == b).all() for a, b in zip((raw, *targets), R.bucket_counts(d, trusted, block_ids=7)))
    assert np.allclose(R.ratios_of(sum(targets), raw), brute_ratios(docs + ODD, ids)) and all(t.any() for t in targets)
    want = brute_ratios(docs + ODD, ids)
    odd = {doc for doc, _, _ in ODD}
    texts = {doc: text for doc, text, _ in docs if doc not in odd}
    for r in R.judge(d, labels_of(spark, labels)).collect():
        if r.doc_id in texts:
            found = R.buckets(*R.word_codes((texts[r.doc_id] or "").encode()))
            assert not len(found) or abs(r.llr - want[found].mean()) < 1e-9


def test_sides_of_labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, 0), (4, 0, 0), (5, None, None), (6, None, 1), (7, 1, None), (None, 0, 1),
            (8, 1, 0), (8, 1, 0), (9, 0, 0), (9, 1, 1)]
    assert sorted(tuple(r) for r in R.sides(labels_of(spark, rows)).collect()) == [
        (1, True), (2, False), (3, False), (6, False), (7, True), (8, True), (9, False)]
