"""Line dedup against brute force, and its runs as they grow."""

import hashlib

from docmill.llm import line_dedup
from docmill.llm.common import SPACES


def brute(rows, min_chars=20, min_docs=3):
    """Rows (doc_id, text) to (doc_id, kept text, lines, dropped lines)."""
    holders = {}

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def got(df):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


SHARED = "A line of Some Length that is shared"
ROWS = [
    (1, f"{SHARED}\nfirst"), (2, f"  {SHARED.upper()}\t\nsecond"), (3, f"x\n\x0b{SHARED.lower()}\r\n{SHARED}"),
    (4, "short\nshort"), (5, "short"), (6, "short"), (7, None), (8, ""), (9, "\n\n"),
    (None, f"{SHARED}\nno id"), (None, None), (10, "in two documents only, so it stays"),
    (11, "in two documents only, so it stays"), (12, "nineteen code pointé"), (13, "nineteen code pointé"),
    (14, "nineteen code pointé"), (15, "repeated row with a long enough line"), (15, "repeated row with a long enough line"),
    (16, "É ist kein a bis z, also anders"), (17, "é ist kein a bis z, also anders"), (18, "é ist kein a bis z, also anders"),
    (19, "\n".join(f"line number {i} of a very long document" for i in range(20_000))),
    (20, "\n".join(f"line number {i} of a very long document" for i in range(0, 20_000, 2))),
    (21, "\n".join(f"line number {i} of a very long document" for i in range(0, 20_000, 3))),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "en", 1, 2, 3) for d, t in rows],
                                 "doc_id long, text string, line1 string, n_lines int, version int, lines_gone int")


def test_brute_force_with_odd_rows(spark):
    assert got(line_dedup.dedup_lines(frame(spark))) == sorted(brute(ROWS), key=repr)


def test_batches_and_fanout_do_not_matter(spark):
    want = sorted(brute(ROWS), key=repr)
    assert got(line_dedup.dedup_lines(frame(spark), batches=7, fanout=3)) == want
    assert got(line_dedup.dedup_lines(frame(spark), batches=1)) == want
    assert got(line_dedup.dedup_lines(frame(spark), batches=4)) == want
    assert got(line_dedup.dedup_lines(frame(spark), batches=9, fanout=2)) == want


def test_empty_table(spark):
    assert got(line_dedup.dedup_lines(frame(spark).limit(0))) == []


def test_apply_keeps_columns_and_untouched_texts(spark):
    docs = spark.createDataFrame([(d, t, None if t is None else len(t), "x") for d, t in ROWS],
                                 "doc_id long, text string, n_chars long, line_hash text".replace("line_hash text", "extra string"))
    out = line_dedup.apply(docs)
    assert out.schema == docs.schema
    want = {(d, t if not gone else kept) for (d, t), (_, kept, _, gone) in zip(ROWS, brute(ROWS))}
    rows = out.collect()
    assert {(r.doc_id, r.text) for r in rows} == want and len(rows) == len(ROWS)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_runs_are_levelled_and_judge_later_batches(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batches = [[(i * 10 + j, f"{SHARED}\nown line of document {i * 10 + j}") for j in range(3)] for i in range(5)]
    for n, rows in enumerate(batches, 1):
        runs.add(line_dedup.line_hashes(frame(spark, rows)))
        held = [len(level) for level in runs.levels]
        assert all(x < 2 for x in held) and sum(x << i for i, x in enumerate(held)) == n
    judge = runs.judge()
    assert judge.frequent.count() == 1 and judge.frequent.first()["last_doc"] == 42
    late = line_dedup.line_hashes(frame(spark, [(1, f"{SHARED}\na line that no run holds yet")]))
    assert judge.surviving(late).count() == 1 and judge.dropped(late).count() == 1


def shuffled(plan):
    return plan.count("Exchange hashpartitioning")


def test_runs_meet_without_an_exchange(spark, plan):
    runs = line_dedup.LineRuns(spark, fanout=9)
    parts = [line_dedup.line_hashes(frame(spark, [(i * 500 + j, f"line {j % 90} of the documents of this test")
                                                  for j in range(500)])) for i in range(2)]
    for part in parts:
        runs.add(part)
    both = line_dedup.merged(*runs.levels[0])
    assert shuffled(plan(both)) == 0 and "SortMergeJoin" in plan(both)
    assert both.count() == 90 and both.agg({"n_docs": "sum"}).first()[0] == 1000
    judged = runs.judge()
    plain = line_dedup.Judge.__new__(line_dedup.Judge)
    plain.heavy, plain.light = judged.heavy.limit(0), judged.frequent.select("line1", "line2", "last_doc")
    for part in parts:
        assert shuffled(plan(judged.dropped(part))) == 1  # that of the batch's own lines
        for judge in (judged, plain):  # the same lines, taken as heavy ones or joined with the runs
            assert judge.dropped(part).count() + judge.surviving(part).count() == 500
        assert sorted(judged.dropped(part).collect()) == sorted(plain.dropped(part).collect())


def test_brute_force_without_heavy_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", 0)  # no line is heavy, all go through the merge joins
    assert got(line_dedup.dedup_lines(frame(spark))) == sorted(brute(ROWS), key=repr)


def test_digest(spark):
    row = line_dedup.dedup_lines(frame(spark, [(1, "a\nb")])).first()
    assert hashlib.sha256(row.kept_text.encode()).hexdigest() == hashlib.sha256(b"a\nb").hexdigest()
