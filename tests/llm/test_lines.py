"""Line dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.llm.common import list_blocks
from flowloom.llm.linededup import SHORT, drop_repeated_lines, edit_distances_within, line_classes, without_lines

DOCS = "doc_id bigint, text string, gone int, _row string, _key int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], DOCS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(r, s, alphabet, most):
    s = list(s)
    for _ in range(r.randint(0, most)):
        k = r.randint(0, len(s))
        s[k : k + r.randint(0, 1)] = r.choice([[], [r.choice(alphabet)]])
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_distances(tau):
    r = random.Random(tau)
    left = ["".join(r.choices("abcé", k=r.randint(0, 45))) for _ in range(1500)] + ["", "a" * 500]
    right = [changed(r, x, "abcd", tau + 2) for x in left]
    want = [distance(x, y) <= min(tau, min(len(x), len(y)) // 10) for x, y in zip(left, right, strict=True)]
    assert edit_distances_within(left, right, tau).tolist() == want
    assert 200 < sum(want) < 1400
    assert edit_distances_within([], [], tau).tolist() == []


def classes_by_force(rows):
    flat = []
    for i, t in rows:
        if i is not None:
            flat += [(i, k, "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\v\f\r"))) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in flat})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(texts):
        ok = edit_distances_within([x] * k, texts[:k], 2)
        for y in (texts[i] for i in ok.nonzero()[0]):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    head = {}
    for i, k, x in sorted(flat):
        head.setdefault(find(x), (i, k))
    return {(i, k): head[find(x)] for i, k, x in flat}


def test_line_classes(spark):
    r = random.Random(5)
    base = ["".join(r.choices("abcdefé ", k=r.randint(8, 60))).strip() + "z" for _ in range(40)]
    rows = [(i, "\n".join([*(changed(r, r.choice(base), "qw", 3) for _ in range(r.randrange(5))), r.choice(["", "short", " SHORT ", "shorT x"])])) for i in range(80)]
    # families under one long key: many links, chains, and lines that are near by their letters only
    rows += [(100 + i, "the very same words at the start " + "".join(r.choices("abc", k=7))) for i in range(250)]
    rows += [(400 + i, "letters in another order " + "".join(r.sample("abcdefghij", 10))) for i in range(120)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, base[0]), (93, "ab " * 20_000), (94, base[1]), (94, base[1])]
    got = {(x.doc_id, x.line_no): (x.class_doc, x.class_line) for x in line_classes(docs_of(spark, rows)).collect()}
    assert got == classes_by_force(rows) and len(rows) > 10 * SHORT


def test_candidates_grow_with_the_list(spark):
    """A list gives rows in proportion to its lines, not to their pairs."""
    from flowloom.llm.linededup import TAU, _candidates, _scan

    sizes = []
    for n in (200, 400):
        d = docs_of(spark, [(i, f"one and the same beginning of a line {i:04d}") for i in range(n)])
        lines = d.select("doc_id", "text").mapInArrow(_scan(TAU), "doc_id bigint, line_no int, h bigint, sig bigint, keys array<bigint>")
        pairs, rows = _candidates(lines, TAU)
        sizes.append((pairs.count(), rows.count()))
    assert sizes[1][0] < 2.6 * sizes[0][0] < 2.6 * 12 * 200 and sizes[1][1] < 2.6 * sizes[0][1]


def test_blocks_meet_once(spark):
    """Any two rows of a key meet in one pair of sides."""
    d = spark.range(60).selectExpr("id % 2 AS k", "id AS h", "IF(id % 2 = 0, 1, 7) AS blocks")
    groups: dict = {}
    for r in list_blocks(d, "k", "h", "blocks").collect():
        groups.setdefault(r.pair, []).append((r.h, r.side))
    met = []
    for g in groups.values():
        met += [(min(a, b), max(a, b)) for a, s in g for b, t in g if (s, t) == (0, 0) and a < b or (s, t) == (1, 2)]
    assert sorted(met) == [(a, b) for a in range(60) for b in range(a + 2, 60, 2)]


def test_cut_texts(spark):
    rows = [(1, "a line that repeats itself\nother\n"), (2, "keep this one, too\na line that repeats itselv\n\nend"), (3, None), (4, ""), (5, "A line that repeats itself"), (None, "other")]
    cut = drop_repeated_lines(docs_of(spark, rows))
    assert cut.columns == docs_of(spark, []).columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: rows[0][1], 2: "keep this one, too\n\nend", 3: None, 4: "", 5: "", None: "other"}
    long = spark.createDataFrame([("\n".join(map(str, range(50_000))), list(range(0, 50_000, 2)))], "t string, g array<int>")
    assert long.select(without_lines("t", "g").alias("x")).first().x == "\n".join(map(str, range(1, 50_000, 2)))
    assert line_classes(docs_of(spark, [])).count() == 0 and drop_repeated_lines(docs_of(spark, [])).select(F.count("text")).first()[0] == 0
