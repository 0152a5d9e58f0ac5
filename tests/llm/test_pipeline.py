"""Every stage of the pipeline, and the whole of it, against brute force and edge cases."""

import random
import re

import pytest

import corpus_pipeline as cp

#: columns of documents, and names that operators use inside or return
MORE = ("score", "held_out", "predicted", "hits", "gone", "_row", "_key", "row", "rest", "kept", "component_id", "n", "_", "first", "tokens", "rate", "Group")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in MORE)
WORD = re.compile(r"[^ \t-\r]+")


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[7] * len(MORE)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables that stages read besides documents."""
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "which of these seven numbers is the largest prime below one hundred"), (2, None), (3, " ")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=r.randint(3, 7))) for _ in range(400)]
    line = lambda n: " ".join(r.choices(words, k=n))
    out = []
    for i in range(300):
        out.append((i, "\n".join(line(12) for _ in range(3)) + (" vile scum" if i % 3 == 0 else "")))
    shared = line(60)
    out += [(i, f"{line(20)}\n{shared}\n{line(10)}\n{shared}") for i in range(300, 320)]
    copy = "\n".join([line(40), shared, line(45)])
    out += [(i, copy) for i in range(320, 330)]
    out += [(i, copy.replace(copy.split()[5], f"new{i}", 1)) for i in range(330, 340)]
    out += [(340, f"{line(9)} Which of these seven numbers is the largest prime below one hundred {line(9)}")]
    out += [(350, None), (351, ""), (352, " \n "), (353, "x " * 30_000), (None, line(15)), (None, None), (20, out[20][1]), (22, "another text " + line(9))]
    return out


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def check_columns(before, after):
    assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_toxicity_stage(spark, folder, rows):
    docs = table_of(spark, rows)
    out = cp.toxicity(spark, docs, folder)
    check_columns(docs, out)
    got = out.collect()
    assert {r.doc_id for r in got if r.doc_id is not None and r.doc_id < 300} == {i for i in range(300) if i % 3}
    assert {r["_row"] for r in got} == {7} and {350, 351, 352, 353, None} <= {r.doc_id for r in got}


def test_line_stage(spark, folder, rows):
    docs = table_of(spark, rows)
    out = cp.line_dedup(spark, docs, folder)
    check_columns(docs, out)
    got = {r.doc_id: r for r in out.where("doc_id IS NOT NULL").collect()}
    assert out.count() == len(rows)
    shared = dict(rows)[300].split("\n")[1]
    assert [i for i in range(300, 340) if shared in got[i].text] == [300] and got[300].text.count(shared) == 1
    copies = [got[i].text for i in range(320, 330)]
    assert len(set(copies)) == 1 and len(copies[0].split("\n")) == 2  # all members of a group lose the same lines
    assert got[350].text is None and got[351].text == "" and all(len(r.text or "") == (r.n_chars or 0) for r in got.values())
    assert got[5].text == dict(rows)[5]


def test_near_stage(spark, folder, rows):
    docs = table_of(spark, rows)
    out = cp.near_dedup(spark, docs, folder)
    check_columns(docs, out)
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            for x in sets[a]:
                for y in sets[b]:
                    k = len(x & y)
                    if a < b and k and 100 * k >= 80 * len(x | y):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    got = out.collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert ids == sorted(i for i in root if find(i) == i) and len(set(ids)) == len(ids)
    assert sum(r.doc_id is None for r in got) == 2
    assert next(r.text for r in got if r.doc_id == 22) == min(t for i, t in rows if i == 22)


def test_decontamination_stage(spark, folder, rows):
    docs = table_of(spark, rows)
    out = cp.decontamination(spark, docs, folder)
    check_columns(docs, out)
    assert out.count() == len(rows) - 1 and out.where("doc_id = 340").count() == 0


def test_mixing_stage(spark, folder, rows):
    docs = table_of(spark, rows)
    out = cp.mixing(spark, docs, folder).collect()
    assert len(out) == len(rows) and {r.rate for r in out if r.doc_id in (350, 351, 352)} == {1.0}
    assert all(r.rate >= 0 for r in out)
    total = sum(r.tokens for r in out)
    spent = sum(r.rate * r.tokens * r.p[r.domains.index("toxic")] for r in out)
    assert abs(spent / total - out[0].miss[out[0].domains.index("toxic")]) < 1e-6 and spent / total < 0.01


def test_empty_tables(spark, tmp_path, folder):
    empty = table_of(spark, [])
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, empty, folder)
        check_columns(empty, out)
        assert out.count() == 0
    assert cp.mixing(spark, empty, folder).count() == 0


def test_run(spark, folder, rows, tmp_path):
    at = str(tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    table_of(spark, rows).write.parquet(f"{at}/documents.parquet")
    got = [r.doc_id for r in cp.run(spark, at).select("doc_id").collect()]
    ids = [i for i in got if i is not None]
    assert len(ids) == len(set(ids)) and not set(ids) & {340, *range(321, 340), *(i for i in range(300) if i % 3 == 0)}
    assert {i for i in range(300) if i % 3} | {300, 320, 350, 351, 352, 353} <= set(ids)
