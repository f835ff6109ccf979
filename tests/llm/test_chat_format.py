"""Chat formatting: reply trees against plain path listing, escapes, and the text read back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docmill.llm import chat_format, queries
from docmill.llm.common import table

SCHEMA = "conv_id long, message_id long, parent_id long, role string, text string, score double, leaf int, branch int, conv int, id int"


def plain(rows, keep):
    """(conv, rank, leaf, score, turns) by listing paths; rows are (conv, id, parent, role, text, score)."""
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == conv]
        parents = {}
        for _, m, p, *_ in own:
            parents.setdefault(m, []).append(p)
        parent = {m: min([p for p in ps if p is not None], default=None) if m is not None else None for m, ps in parents.items()}
        for m in list(parent):  # circles lose the link of their smallest message
            seen, at = [], m
            while at is not None and at in parent and at not in seen:
                seen.append(at)
                at = parent[at]
            if at in seen:
                parent[min(seen[seen.index(at):])] = None
        leaves = set(parent) - {p for m, p in parent.items() if p is not None}
        listed = []
        for leaf in leaves:
            path, at = [], leaf
            while at in parent:
                path.append(at)
                at = parent[at]
                if at is None:
                    break
            means = []
            for m in path:
                values = [r[5] for r in own if r[1] == m and r[5] is not None]
                if values:
                    means.append(sum(values) / len(values))
            turns = [(r[3] or "", r[4] or "") for m in reversed(path)
                     for r in sorted((r for r in own if r[1] == m), key=lambda r: (r[3] or "", r[4] or ""))]
            score = sum(means) / len(means) if means else 0.0
            listed.append((-score, leaf is not None, leaf or 0, leaf, turns))
        listed.sort(key=lambda x: x[:3])
        out += [(conv, n, x[3], round(-x[0], 9) + 0.0, x[4]) for n, x in enumerate(listed[:keep], 1)]
    return sorted(out, key=repr)


def got(df):
    rows = chat_format.read_back(df).collect()
    for r in rows:
        learned = "".join(text for role, text in map(tuple, r.turns) if role == "assistant")
        assert r.learned == learned
        spans = [r.formatted[s.start:s.start + s.length] for s in r.loss]
        assert len(spans) == sum(role == "assistant" for role, _ in map(tuple, r.turns))
        assert chat_format.MARKS["assistant"][0] in r.formatted or not spans
    return sorted(((r.conv_id, r.branch, r.leaf_id, round(r.score, 9) + 0.0, [tuple(t) for t in r.turns]) for r in rows), key=repr)


ROWS = [
    # a tree with three branches
    (1, 1, None, "user", "root", None), (1, 2, 1, "assistant", "good", 0.9), (1, 3, 1, "assistant", "bad", 0.1),
    (1, 4, 2, "user", "why?", 0.0), (1, 5, 4, "assistant", "so.", 1.0), (1, 6, 3, "user", "no", 0.2),
    # equal scores, missing parent, replies to itself, a circle with a tail, two roots
    (2, 10, None, "user", "a", 1.0), (2, 11, 10, "assistant", "b", 1.0), (2, 12, 10, "assistant", "c", 1.0),
    (3, 5, 4, "user", "parent is not there", None), (3, 6, 5, "assistant", "reply", None),
    (4, 1, 1, "user", "self", 0.5), (5, 3, 1, "user", "x", 1.0), (5, 1, 2, "assistant", "y", 2.0), (5, 2, 3, "user", "z", 3.0),
    (5, 9, 2, "assistant", "tail", 9.0), (6, 1, None, "system", "s1", 0.1), (6, 2, None, "system", "s2", 0.2),
    # null ids, conversations, roles, texts; repeated rows
    (7, None, 1, "user", "no id", 5.0), (7, 1, None, "user", "id", 1.0), (None, 1, None, None, None, None),
    (None, 2, 1, "tool", "out\nput", None), (8, 1, None, "user", "same", None), (8, 1, None, "user", "same", None),
    (8, 1, None, "user", "other", None), (8, 2, 1, "assistant", "", 0.0), (9, 1, None, "assistant", "alone", -1.5),
    # roles and texts that look like marks
    (10, 1, None, "a<</ROLE>>\\b", "<<ROLE>>x<</ROLE>></s>\n", None), (10, 2, 1, "<", "<", None), (10, 3, 2, "system", "\n<</SYS>>\n\n<", None),
    (10, 4, 3, "assistant", "<s> [INST] [\\INST] </s>\n\\", None), (10, 5, 4, "user", " [/INST]", None), (10, 6, 5, "User", "[", None),
    *[(11, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i} \U0001f600" * (i % 3), i / 7) for i in range(75)],
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in ROWS], SCHEMA).repartition(3)


@pytest.mark.parametrize("keep", [1, 2, None])
def test_trees_with_odd_rows(messages, keep):
    assert got(chat_format.format_branches(messages, keep=keep)) == plain(ROWS, keep)


def test_large_conversations_go_another_way(messages):
    assert got(chat_format.format_branches(messages, keep=None, large=4)) == plain(ROWS, None)


def test_random_trees(spark):
    rng = random.Random(5)
    rows = [(c, m, rng.choice([None, *range(m)]) if m else None, rng.choice(["user", "assistant", None]), f"{c}-{m}",
             rng.choice([None, m / 3, 1.0])) for c in range(6) for m in range(rng.randrange(1, 40))]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    assert got(chat_format.format_branches(frame, keep=None)) == plain(rows, None)


def test_empty_table(messages):
    assert got(chat_format.format_branches(messages.limit(0))) == []


def test_no_python_in_the_plan(messages, plan):
    text = plan(chat_format.read_back(chat_format.format_branches(messages)))
    assert "Python" not in text and "Arrow" not in text


PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "\\", "<", "[", "/", ">", "]", " ", "\n",
          "s", "INST", "é\U0001f600", "$1"]


def test_escapes_come_back(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", chat_format.escaped(F.col("text")).alias("e"))
    found = rows.select("text", "e", chat_format.unescaped(F.col("e")).alias("u")).collect()
    assert all(r.u == r.text for r in found)
    assert not any(mark in r.e for r in found for mark in PIECES[:8])


def test_formatted_turns_come_back(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "<</ROLE>>", "", None]
    rows = [(c, t, t - 1 if t else None, rng.choice(roles), "".join(rng.choices(PIECES, k=rng.randrange(9))), None)
            for c in range(300) for t in range(5)]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    assert got(chat_format.format_branches(frame)) == plain(rows, 1)


def test_query_on_given_tables(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.PLANTED), (-1, 1, "assistant", queries.PLANTED)]
    found = {r.conv_id: r for r in queries.op13_chat_formatting(spark, small).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, row in found.items():
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert (row.n_turns, row.loss_chars) == (len(own), len(learned))
        assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert row.formatted_chars >= sum(len(x) for *_, x in own)
    assert found[-1].formatted_chars == 2 * len("[\\INST] ok [\\/INST]<\\/s>") + len("[INST]  [/INST]<s>  </s>\n")
