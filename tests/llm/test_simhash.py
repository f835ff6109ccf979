"""SimHash near-dedup against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from docmill.llm import simhash


def brute_fingerprint(text, n=3):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, bits=3):
    """Least index reachable, for a list of fingerprints."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root[i], root[j]
                if a != b:
                    root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "one two", "A b C", "a b c d", "x " * 70_000, "é É ß a",
                                  "tab\tand\x0bvertical\x0cform feed", "日本 語 です ね"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def clusters(seed, n, spread):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    out = {0, 1, 7, (1 << 64) - 1}
    while len(out) < n:
        fp = rng.choice(centres)
        for _ in range(rng.randint(0, spread)):
            fp ^= 1 << rng.randrange(64)
        out.add(fp)
    return sorted(out)


@pytest.mark.parametrize("bits,max_posting,spread", [(3, 4096, 6), (3, 5, 6), (3, 2, 3), (2, 4, 4), (0, 4096, 2)])
def test_links_connect_what_brute_force_connects(spark, bits, max_posting, spread):
    fps = clusters(bits + max_posting, 300, spread)
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    links = simhash.close_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, max_posting)
    rows = [(a % (1 << 64), b % (1 << 64)) for a, b in links.collect()]
    assert all(0 < (a ^ b).bit_count() <= bits for a, b in rows)
    want = brute_components(fps, bits)
    at = {fp: i for i, fp in enumerate(fps)}
    root = list(range(len(fps)))
    for a, b in rows:
        x, y = root[at[a]], root[at[b]]
        if x != y:
            root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == want


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.close_fingerprints(spark.createDataFrame([], "fp long"), 4)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)] + [(7, 3)] * 3
    rows = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    found = {r.node: r.root for r in rows}
    assert found == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def odd_rows():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n"), (None, "alpha beta"), (None, None), (4, "alpha beta"), (4, "alpha beta"),
            (5, "ALPHA  beta")]
    for i in range(10, 40):
        base = [rng.choice(WORDS) for _ in range(400)]
        for j in range(4):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(400)] = rng.choice(WORDS)
            rows.append((i * 10 + j, " ".join(copy)))
    rows.append((1_000_000, " ".join(rng.choice(WORDS) for _ in range(200_000))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "c") for d, t in rows],
                                 "doc_id long, text string, fp int, component int, root string")


def test_brute_force_with_odd_rows(spark):
    rows = odd_rows()
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    known = sorted((d, brute_fingerprint(t)) for d, t in rows if d is not None)
    roots = brute_components([fp for _, fp in known])
    want = sorted((d, fp, known[r][0]) for (d, fp), r in zip(known, roots))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found if r.doc_id is not None) == want
    assert all(r.component_id is None for r in found if r.doc_id is None)


def test_apply_keeps_one_of_each(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = simhash.apply(docs)
    assert kept.schema == docs.schema
    found = simhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({r.component_id for r in found})
    assert ids.count(None) == 2


def test_empty_table(spark):
    docs = frame(spark, odd_rows()).limit(0)
    assert simhash.near_duplicates(docs).collect() == [] and simhash.apply(docs).collect() == []


def test_apply_keeps_rows_of_one_id_in_several_components(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) + str(rng.randint(0, 99)) for _ in range(80))
                  for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "w"), (2, a, "x"), (2, c, "x"), (3, c, "x"), (4, d, "x"), (4, d.upper(), "x"),
            (5, b, "x"), (None, a, "x"), (None, a, "x")]
    want = [(1, a, "x"), (1, b, "w"), (2, c, "x"), (4, min(d, d.upper()), "x"), (None, a, "x"), (None, a, "x")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        assert sorted(map(tuple, simhash.apply(docs).collect()), key=repr) == sorted(want, key=repr)
