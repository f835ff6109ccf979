"""Text, vector and record expressions against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmill.functions import prompts, records as R, text as T, vectors as V
from docmill.workload.fixtures import documents

TEXTS = ["", "the cat the dog CATS cats", "déjà vu word2 word_ word word! über ÜBER straße", "abcd abc abcd-efgh efgh",
         "zeta beta zeta beta gamma", "One two three. Two three four! Three four five? six", "...", "İstanbul istanbul",
         "a1b2 mixed2word plain"]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "x": pd.Series(values, dtype=object)}), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr.alias("r")).collect()]


def keywords(text, n):
    return [w for w, _ in Counter(re.findall(r"\b[a-zA-Z]{4,}\b", text.lower())).most_common(n)]


def test_keywords(spark, small):
    texts = TEXTS + [r[0] for r in documents(spark, small).select("text").collect()]
    for n in (3, 10):
        assert column(spark, texts, T.top_keywords(F.col("x"), n)) == [keywords(t, n) for t in texts]


def test_keywords_of_many_ties_and_edges(spark):
    rng = random.Random(3)
    some = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 7))) for _ in range(60)]  # words that begin alike
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts += ["aaab aab aaab aaaab aaab", "word " * 30_000 + "other other", " ".join(f"once{chr(97 + i % 26)}" for i in range(40))]
    for n in (0, 1, 2, 10, 100):
        assert column(spark, texts, T.top_keywords(F.col("x"), n)) == [keywords(t, n) for t in texts]
    assert column(spark, [None, "", "a b"], T.top_keywords(F.col("x"))) == [[], [], []]


def test_keywords_of_long_texts_take_no_time_for_every_pair_of_words(spark, plan):
    word = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    text = " ".join(word(i) for i in range(100_000)) + " " + " ".join(word(i) for i in range(99_999, -1, -2))
    assert column(spark, [text], T.top_keywords(F.col("x"), 3)) == [[word(1), word(3), word(5)]]
    # occurrences are sorted as plain strings: structs with their places took most of the time
    made = plan(spark.createDataFrame([("x",)], "x string").select(T.top_keywords(F.col("x"))))
    assert "sort_array(transform(regexp_extract_all" not in made


def test_keyword_modes(spark):
    df = spark.createDataFrame([("some text text", " a, b ,, c d ,"), ("some text text", None), ("x", "")], "x string, a string")
    rows = df.select(T.keywords(F.col("x"), "llm", F.col("a")).alias("k"), T.keywords(F.col("x")).alias("f")).collect()
    assert [r.k for r in rows] == [["a", "b", "c d"], ["text", "some"], []]
    assert rows[0].f == ["text", "some"]
    assert df.select(T.parse_keyword_list(F.lit(None).cast("string"))).first()[0] == []


def test_strip_and_words(spark):
    space = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    values = [f"{c}a{c}b{c}" for c in space] + ["", " ", "a", space]
    assert column(spark, values, T.strip(F.col("x"))) == [v.strip() for v in values]
    assert column(spark, values, T.words(F.col("x"))) == [v.split() for v in values]


def extract(text, n):
    parts = re.split(r"(?<=[.!?]) +", text.strip())
    toks = [re.findall(r"\w+", s.lower()) for s in parts]
    counts = Counter(w for ws in toks for w in ws)
    score = {i: sum(counts[w] for w in ws) / len(ws) for i, ws in enumerate(toks) if ws}
    best = sorted(sorted(score, key=lambda i: (-score[i], i))[:n])
    return " ".join(parts[i] for i in best) if best else " ".join(parts[:n])


def test_summaries(spark, small):
    texts = TEXTS + [r[0] for r in documents(spark, small).select("text").collect()]
    texts = [t for t in texts if "İ" not in t]
    for form in (T.extractive, T.extractive_batch):
        assert column(spark, texts, form(F.col("x"), 2)) == [extract(t, 2) for t in texts]
    assert column(spark, [None, "a. b"], T.extractive_batch(F.col("x"), 1)) == [None, "a."]
    assert column(spark, texts, T.lead(F.col("x"), 2)) == [
        " ".join(re.split(r"(?<=[.!?]) +", t.strip())[:2]) for t in texts]


def test_phrase(spark):
    values = ["With, the cat", "with  THE", "within the", "with then", "the with", "with_the", "a with\nthe b", "wîth the"]
    got = column(spark, values, T.contains_phrase(F.col("x"), "with the"))
    assert got == [True, True, False, False, False, False, True, False]
    assert column(spark, ["l'été à Nîmes", "Nîmes à"], T.contains_phrase(F.col("x"), "À Nîmes")) == [True, False]
    with pytest.raises(ValueError):
        T.contains_phrase(F.col("x"), " ,")


def embed(text, dim):
    out = [0] * dim
    for w in re.findall(r"\w+", text.lower()):
        out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    size = math.sqrt(sum(v * v for v in out))
    return [v / size if size else 0.0 for v in out]


def test_hashed_embedding(spark):
    texts = [t for t in TEXTS if "İ" not in t]
    for dim in (8, 64):
        for got, want in zip(column(spark, texts, V.hashed_embedding(F.col("x"), dim)), [embed(t, dim) for t in texts]):
            assert got == pytest.approx(want, abs=1e-12)


def test_vector_math(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(V.squared_l2(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == 13.0 and rows[0][1] == pytest.approx(13 / math.sqrt(5 * 34)) and rows[1][1] == 0.0


def test_summary_score(spark):
    values = [None, "", "short", "x" * 29, "x" * 30, "x" * 150, "x" * 900, "Lorem IPSUM " + "x" * 100, "lorem ipsum"]
    assert column(spark, values, R.summary_score(F.col("x"))) == pytest.approx(
        [0.2, 0.2, 0.2, 0.2, 0.1, 0.5, 1.0, 0.1, 0.2])


def test_evaluation(spark):
    bad = (0.0, "Evaluation error", True)
    cases = [
        ("s", '{"score": 7, "reason": "ok"}', (7.0, "ok", False)), ("s", '{"score": 4, "reason": "ok"}', (4.0, "ok", True)),
        ("s", '{"reason": "x"}', (0.0, "x", True)), ("s", '{"score": null}', bad), ("s", '{"score": "7"}', bad),
        ("s", "[1, 2]", bad), ("s", "nope", bad), ("s", '{"score": 7} trailing', bad), ("s", "", bad), ("s", None, bad),
        ("", '{"score": 7}', (0.0, "Empty summary", True)), (None, '{"score": 7}', (0.0, "Empty summary", True)),
        ("s", '{"score": 4.5, "reason": null}', (4.5, None, True)), ("s", '{"score": 7},{"a": 1}', bad),
        ("s", ' {"score": 7}\n', (7.0, "", False)), ("s", '{"score": {"a": 1}}', bad), ("s", "7", bad),
        ("s", '{"score": 5}', (5.0, "", False)), ("s", "{}", (0.0, "", True)), ("s", '{"score": [1]}', bad),
    ]
    df = spark.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(cases)], "i int, s string, a string")
    got = df.orderBy("i").select(R.evaluation(F.col("s"), F.col("a")).alias("e")).select("e.*").collect()
    for (s, a, want), row in zip(cases, got):
        assert tuple(row) == want, (s, a)


def test_metadata_and_ids(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), ({}, {"x": "y"}), ({"k": "v"}, {})],
                               "b map<string,string>, o map<string,string>")
    got = [r[0] for r in df.select(R.merged_metadata(F.col("b"), F.col("o"))).collect()]
    assert got == [{"a": "1", "b": "3", "c": "4"}, {"x": "y"}, {"k": "v"}]
    lone = spark.createDataFrame([({"a": "1"}, None), (None, {"a": "1"}), (None, None)], df.schema)
    assert [r[0] for r in lone.select(R.merged_metadata(F.col("b"), F.col("o"))).collect()] == [{"a": "1"}, {"a": "1"}, None]
    one = spark.range(1).select(R.vector_id(F.lit("doc1"), F.lit(3)), R.cache_key(F.lit("a:b")),
                                R.cache_doc(R.cache_key(F.lit("a:b"))), R.is_yes(F.lit("Well, YES")),
                                R.is_yes(F.lit(None).cast("string"))).first()
    assert tuple(one) == ("doc1_chunk_3", "doc:a:b", "a", True, False)


def test_json(spark):
    df = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, None)], "doc_id long, chunk string")
    packed = df.select(R.as_json("doc_id", "chunk").alias("v"))
    back = packed.select(R.from_json(F.col("v"), "doc_id long, chunk string").alias("r")).select("r.*")
    assert sorted(back.collect()) == sorted(df.collect())
    assert packed.orderBy("v").collect()[1].v == '{"doc_id":2}'


def test_iso_time(spark):
    got = spark.sql("select timestamp'2024-01-02 03:04:05' a, timestamp'2024-01-02 03:04:05.000600' b")
    row = got.select(R.iso_time(F.col("a")), R.iso_time(F.col("b"))).first()
    assert tuple(row) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000600")


def test_prompts(spark):
    row = spark.range(1).select(
        prompts.summarize(F.lit("abc")), prompts.keywords(F.lit("x" * 3000), 5),
        prompts.judge(F.lit("y" * 3000)), prompts.incident(F.lit("INC-7")), prompts.evaluate(F.lit("{n} {summary}"))).first()
    assert row[0] == "Summarize the following section:\n\nabc"
    assert "\n\n" + "x" * 3000 + "\n\n" in row[1] and "up to 5" in row[1]  # whole texts
    assert row[2].endswith("\n\n" + "y" * 3000)
    assert "Summary:\n{n} {summary}\n\nPlease" in row[4]
    assert row[3] == "User asked about an incident: INC-7. Look it up and summarize."


def test_in_row_functions_do_not_shuffle(spark, small, plan):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    df = docs.select(T.top_keywords(F.col("text")), T.extractive(F.col("text")), V.hashed_embedding(F.col("text")))
    assert "Exchange" not in plan(df) and "Python" not in plan(df)
