"""Line dedup, near-duplicate documents and vectors, top-k, archives and the pipeline, against brute force."""

import gzip
import hashlib
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterkit.llm import components, groups, line_dedup, lsh_forest, nn_descent, pivot_topk, warc
from raterkit.session import scratch_path

SF_SMALL, SF_CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

# --- components


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299), (300, 299), (None, 5)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(1, 41)} == {1} and {out[200 + i] for i in range(50)} == {100} and out[300] == 299
    assert len(out) == 40 + 51 + 2
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_and_pairs():
    label = groups.spanning(6, np.array([4, 2, 1]), np.array([5, 4, 2]))
    assert label.tolist() == [0, 1, 1, 3, 1, 1]
    pairs = {(int(a), int(b)) for i, j in groups.pairs_within(np.array([0, 3, 4, 6]), None) for a, b in zip(i, j)}
    assert pairs == {(0, 1), (0, 2), (1, 2), (4, 5)}


# --- lines


def edits(a, b):
    """Edit distance by the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_drops(docs, least):
    """(doc_id, dropped line numbers) of every row."""
    key = lambda i: (docs[i][0] if docs[i][0] is not None else 2**63 - 1, int(hashlib.sha256((docs[i][1] or "").encode()).hexdigest()[:15], 16), i)
    first, lines = {}, []
    for i in sorted(range(len(docs)), key=key):
        for p, line in enumerate(docs[i][1].split("\n") if docs[i][1] is not None else []):
            if len(line) >= least:
                lines.append(((*key(i), p), line))
                first.setdefault(line, (*key(i), p))
    near = {a for a in first for b in first if first[b] < first[a] and abs(len(a) - len(b)) <= 1 and edits(a, b) == 1}
    drops = {i: [] for i in range(len(docs))}
    for at, line in lines:
        if line in near or first[line] != at:
            drops[at[2]].append(at[3])
    return sorted([(str(docs[i][0]), ",".join(map(str, sorted(v)))) for i, v in drops.items()])


def counted(df, least):
    return sorted((str(x.doc_id), x.dropped) for x in line_dedup.line_counts(df, least).collect())


def test_line_dedup_against_brute_force(spark, monkeypatch):
    r = random.Random(6)
    base = ["".join(r.choice("abé ") for _ in range(r.randint(4, 40))) for _ in range(25)]

    def change(line):
        k = r.randrange(len(line))
        return r.choice((line, line[:k] + line[k + 1 :], line[:k] + "x" + line[k:], line[:k] + "y" + line[k + 1 :], line + "z", "z" + line))

    docs = [(i, "\n".join(change(r.choice(base)) for _ in range(r.randint(0, 6)))) for i in range(80)]
    docs += [(90, None), (91, ""), (None, base[0] + "\n" + base[1]), (92, "aaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaa"), (93, "x" * 300 + "\n" + "x" * 299)]
    docs += [(None, base[0] + "\n" + base[2]), (None, base[0] + "\n" + base[1]), (5, docs[5][1]), (5, docs[6][1] + "\nquite another"), (None, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("q") for c in ("d", "r", "line", "row", "number", "dropped")})
    for least, segment in ((4, 256), (4, 8), (20, 8)):
        monkeypatch.setattr(line_dedup, "SEGMENT", segment)
        assert counted(df, least) == plain_drops(docs, least)


def test_unique_lines_stay_under_null_and_repeated_ids(spark):
    rows = [(None, "completely different and unique first line\na line that stands in two documents"),
            (None, "something else altogether in this document\na line that stands in two documents"),
            (7, "a quite unique text under a repeated id"), (7, "another text that repeats only the id\na line that stands in two documents!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = "\n".join(r.text for r in line_dedup.line_stage(spark, docs, "").collect())
    for line in ("completely different and unique first line", "something else altogether in this document", "a quite unique text under a repeated id",
                 "another text that repeats only the id", "a line that stands in two documents!"):
        assert line in left
    assert left.count("a line that stands in two documents") == 1


def test_long_lines(spark):
    line = "".join(random.Random(2).choice("abcdefghij") for _ in range(300_000))
    rows = [(1, line), (2, line[:77_777] + "X" + line[77_778:]), (3, line[:290_000] + line[290_001:]), (4, "Y" + line), (5, line[:9] + "ZZ" + line[11:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x[1] for x in counted(docs, 20)] == ["", "0", "0", "0", ""]


def test_line_stage(spark):
    same = "this line stands in several documents"
    rows = [(1, f"{same}\nshort", "x", 6), (2, same, "x", 6), (3, f"own text of the third one\n{same}!", "x", 6), (4, "", "x", 6), (5, None, "x", 6), (2, same, "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, n_chars int")
    out = line_dedup.line_stage(spark, docs, "")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 3, 4, 5} and got[1].text == rows[0][1] and got[3].text == "own text of the third one" and got[3].n_chars == 25
    assert line_dedup.line_stage(spark, docs.limit(0), "").count() == 0


def test_line_dedup_uses_no_python(spark):
    plan = line_dedup.op2_line_dedup(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- near-duplicate documents


def plain_groups(docs):
    sets = []
    for _, text in docs:
        w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(docs)
    link = [[i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            for j in range(n):
                if link[k][j] and j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((docs[i][0], sum(map(bool, link[i])), min(docs[j][0] for j in seen)))
    return sorted(out)


def near_docs(r, n):
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    docs, i = [], 0
    while i < n:
        text = [r.choice(words) for _ in range(r.choice((1, 3, 6, 40, 120)))]
        for _ in range(r.choice((1, 1, 2, 6))):
            own = list(text)
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                own[r.randrange(len(own))] = r.choice(words)
            docs.append((i, " ".join(own) if r.random() < 0.7 else "  ".join(own).upper()))
            i += 1
    return docs


def test_near_documents_against_brute_force(spark):
    docs = near_docs(random.Random(8), 150) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("size", F.lit(1))
    got = sorted((r.doc_id, r.n_links, r.class_id) for r in lsh_forest.jaccard_groups(df).collect())
    assert got == plain_groups(docs)
    stage = lsh_forest.near_stage(spark, df, "")
    assert stage.columns == df.columns
    assert sorted(r.doc_id for r in stage.collect()) == sorted({c for _, _, c in got})


def test_large_near_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK", 4)
    docs = near_docs(random.Random(9), 60)
    text = [f"w{k}" for k in range(100)]
    docs += [(1000 + k, " ".join(text[:k] + ["other"] + text[k + 1 :])) for k in range(0, 60, 2)]
    got = sorted((r.doc_id, r.n_links, r.class_id) for r in lsh_forest.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == plain_groups(docs)


def test_near_documents_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text than that one here"), (None, "a b c d e f g"), (7, "x y z"), (None, "p q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_links, str(r.class_id)) for r in lsh_forest.jaccard_groups(df).collect())
    assert got == sorted([("1", 2, "1"), ("1", 2, "1"), ("1", 0, "1"), ("None", 2, "1"), ("7", 0, "7"), ("None", 0, "None")])
    assert lsh_forest.jaccard_groups(df.limit(0)).count() == 0
    assert lsh_forest.near_stage(spark, df, "").count() == 6


def test_prefixes_are_shortened_until_the_target(spark):
    rng = np.random.default_rng(12)
    shape = (lsh_forest.TREES, lsh_forest.DEPTH)
    rows = []
    for i in range(40):  # pairs that agree in six values of seven, but in no prefix of more than 4
        labels = rng.integers(0, 2**32, shape, dtype=np.uint32)
        other = labels.copy()
        other[:, 4] ^= 1
        rows += [(f"a{i}".encode(), labels), (f"b{i}".encode(), other)]
    hot = rng.integers(0, 2**32, shape, dtype=np.uint32)
    for i in range(50):  # a large group that is found at any length does not hide them
        own = hot.copy()
        own[0] = rng.integers(0, 2**32, shape[1], dtype=np.uint32)
        rows.append((f"c{i}".encode(), own))
    classes = spark.createDataFrame([(bytearray(n), bytearray(x.astype("<u4").tobytes()), bytearray(x.astype(np.uint8).tobytes())) for n, x in rows], "node binary, labels binary, sketch binary")
    recall = lsh_forest.audited_recall(classes)
    assert recall == {7: 0.0, 6: 0.0, 5: 0.0, 4: 1.0, 3: 1.0}
    rounds = []
    found = {bytes(r.node): bytes(r.cluster) for r in lsh_forest.clusters(classes, 7, rounds).collect()}
    assert rounds == [7, 6, 5, 4] and len(found) == 130
    assert all(found[f"a{i}".encode()] == found[f"b{i}".encode()] for i in range(40)) and len(set(found.values())) == 41
    direct = {bytes(r.node): bytes(r.cluster) for r in lsh_forest.clusters(classes, 4).collect()}
    assert found == direct  # step by step finds what the last length finds
    assert len({bytes(r.node) for r in lsh_forest.clusters(classes, rounds=rounds).collect()}) == 130 and rounds[4:] == [5, 4]
    assert lsh_forest.audited_recall(classes.limit(0)) == {}


def test_many_documents_without_an_id(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)]
    rows = [(None, t) for t in texts for _ in range(5)] + [(None, t + " more") for t in texts] + [(3, texts[0])]
    got = sorted((str(r.doc_id), r.n_links, str(r.class_id)) for r in lsh_forest.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("None", 5, "None")] * (6 * 39) + [("None", 6, "3")] * 6 + [("3", 6, "3")])


def test_borderline_pairs_beside_a_large_group(spark):
    assert lsh_forest.found_chance(lsh_forest.THRESHOLD, lsh_forest._depth()) >= lsh_forest.TARGET_RECALL
    docs, n = [], 500
    for i in range(n):  # isolated pairs at 0.8: 40 of 50 shingles
        text = [f"p{i}w{k}" for k in range(49)]
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:20], "other", *text[21:]]))]
    hot = [f"w{k}" for k in range(100)]
    docs += [(2 * n + k, " ".join([*hot, f"end{k}"])) for k in range(150)]
    got = {r.doc_id: (r.n_links, r.class_id) for r in lsh_forest.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i in range(2 * n) if got[i] != (1, i - i % 2)] == []
    assert all(got[2 * n + k] == (149, 2 * n) for k in range(150))


def test_overlaps_of_sets():
    r = random.Random(1)
    left, right = [[np.unique(np.array([r.randrange(9000) for _ in range(n)], dtype=np.int64)) for n in (0, 5, 6000, 300)] for _ in range(2)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert lsh_forest.overlaps(left, right).tolist() == want


# --- near-duplicate vectors


def plain_vectors(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) of every row."""
    able = {r: np.array(v, float) for r, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dims = max((len(v) for v in able.values()), default=0)
    able = {r: np.pad(v, (0, dims - len(v))) for r, v in able.items()}
    link = {i: {j for j in able if i != j and able[i] @ able[j] / (np.linalg.norm(able[i]) * np.linalg.norm(able[j])) >= threshold} for i in able}
    out = []
    for r, (vec_id, _) in enumerate(rows):
        seen, todo = {r}, [r]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(link.get(r, ())), low, low == vec_id))
    return sorted(out, key=str)


def vector_rows(n=400):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(n + i, [float(v) for v in x[i] + 0.05 * rng.standard_normal(16).astype(np.float32)]) for i in range(40)]
    rows += [(600 + i, [float(v) for v in x[0] + 0.02 * rng.standard_normal(16).astype(np.float32)]) for i in range(60)]  # more than a list holds
    rows += [(700 + i, rows[5][1]) for i in range(30)]  # equal vectors
    return rows + [(800, None), (801, []), (802, [0.0] * 16), (803, [1.0, None]), (804, [1.0, float("nan")]), (805, [float("inf")]), (806, [2.0]), (807, [3.0]), (5, rows[5][1]), (None, [1.0]), (None, rows[7][1]),
                   (None, [0.0, 5.0]), (9, rows[11][1]), (9, [-v for v in rows[9][1]]), (9, None), (None, None)]


def test_near_vectors_against_brute_force(spark):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vector_rows()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("node", F.lit(2))
    got = sorted(((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in nn_descent.near_vectors(df).collect()), key=str)
    assert got == plain_vectors(rows)
    assert nn_descent.near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in nn_descent.near_vectors(df.where("vec_id = 3")).collect()] == [(3, 0, 3, True)]


def test_large_groups_linked_across(spark, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK", 32)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 16))
    base, side = np.eye(16)[0], np.eye(16)[1]
    for cosine in (1.0, 0.93, 0.5):  # the first two groups are linked throughout
        centre = cosine * base + math.sqrt(1 - cosine**2) * side
        x = np.concatenate((x, centre + 0.004 * rng.standard_normal((70, 16))))
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in nn_descent.near_vectors(df).collect()), key=str)
    assert got == plain_vectors(rows)


def test_lists_keep_the_best_distinct_neighbours():
    out = nn_descent._best(np.array([1, 1, 1, 2, 1]), np.array([5, 5, 6, 1, 7]), np.array([0.5, 0.5, 0.9, 0.1, 0.7], np.float32), np.array([True, False, True, True, True]), 2)
    assert list(zip(*(c.to_pylist() for c in out.columns)))[:2] == [(1, 6, pytest.approx(0.9), True), (1, 7, pytest.approx(0.7), True)]


def test_saturated_lists_are_enlarged(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in np.eye(20)[0] + 0.01 * rng.standard_normal(20)]) for i in range(60)]
    rows += [(100 + i, [float(v) for v in np.eye(20)[1 + i // 3] + 0.01 * rng.standard_normal(20)]) for i in range(30)]
    _, nodes, dims = nn_descent.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    low = {r.node: r.low for r in nodes.collect()}
    lists = nn_descent.descend(nodes, None, 90, dims, 5)
    sizes = lambda t: {low[r.src]: r["count"] for r in t.groupBy("src").count().collect()}
    grown = nn_descent.enlarge(nodes, lists, 5, 0.9)
    before, after = sizes(lists), sizes(grown)
    assert all(before[i] == 5 for i in range(60)) and all(after[i] == 20 for i in range(60))
    assert all(after[100 + i] == before[100 + i] <= 5 for i in range(30))  # two links each: not saturated
    assert grown.where("sim > 0.99").groupBy("src", "dst").count().where("count > 1").count() == 0


def test_audit_counts_missing_links(spark):
    rows = [(i, [1.0, 0.001 * i]) for i in range(10)]
    keyed, nodes, dims = nn_descent.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    node = {r.low: r.node for r in nodes.collect()}
    all_links = spark.createDataFrame([(node[i], 9, node[0]) for i in range(10)], nn_descent.LINKS)
    assert nn_descent.audit(nodes, all_links, dims, 0.9) == 1.0
    assert nn_descent.audit(nodes, all_links.where(F.col("node").isin([node[i] for i in range(5)])), dims, 0.9) == 0.5


def test_audit_is_not_carried_by_a_large_group(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.eye(24)[0] + 0.001 * rng.standard_normal(24)]) for i in range(100)]
    rows += [(100 + 2 * i + j, [float(v) for v in np.eye(24)[1 + i] + 0.001 * j]) for i in range(20) for j in (0, 1)]
    keyed, nodes, dims = nn_descent.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    node = {r.low: r.node for r in nodes.collect()}
    found = [(node[i], 99, node[0]) for i in range(100)] + [(node[100 + i], 1, node[100]) for i in range(20)]  # half of the pairs
    assert nn_descent.audit(nodes, spark.createDataFrame(found, nn_descent.LINKS), dims, 0.9) == 0.5


def test_all_pairs_are_compared_when_the_descent_stays_below_the_target(spark, monkeypatch):
    rows = [(i, v) for i, v in vector_rows(150) if i is not None and v and len(v) == 16 and any(v)]
    none = spark.createDataFrame([], nn_descent.EDGE)
    monkeypatch.setattr(nn_descent, "descend", lambda *a: none)  # finds nothing
    monkeypatch.setattr(nn_descent, "WHOLE_BLOCK", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in nn_descent.near_vectors(df).collect()), key=str)
    assert got == plain_vectors(rows)


# --- top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[100:140] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(350, None), (400, [float("nan")]), (450, [1.0, None]), (500, []), (550, [100.0]), (None, [1.0]), (None, rows[50][1]), (50, rows[50][1]), (50, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "b": F.lit(2), "row": F.lit(3), "is_query": F.lit(False)})
    able = {r: (i, np.pad(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), (0, 8 - len(v)))) for r, (i, v) in enumerate(rows)
            if v is not None and all(e is not None and math.isfinite(e) for e in v)}
    want = []
    for q, (i, own) in able.items():
        if i is not None and i % 50 == 0:
            best = sorted((-int(own @ v), c is None, c or 0) for r, (c, v) in able.items() if r != q)[:5]
            want += [(i, k, None if none else c, -s) for k, (s, none, c) in enumerate(best, 1)]
    assert sum(i == 50 for i, *_ in want) == 15  # three rows with that id, each a query
    for pivots, block in ((32, 4096), (4, 37), (0, 64)):
        got = pivot_topk.top_k(df, F.col("vec_id") % 50 == 0, pivots=pivots, block=block, query_block=3).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pivot_topk.top_k(df.where("vec_id in (51, 100)"), F.col("vec_id") == 100).count() == 1  # fewer than k
    assert pivot_topk.top_k(df.limit(0), F.col("vec_id") == 50).count() == 0


def test_bounds_spare_evaluations():
    rng = np.random.default_rng(2)
    centers = rng.integers(-300, 300, (20, 8)).astype(float)
    x = np.repeat(centers, 100, axis=0) + rng.integers(-3, 4, (2000, 8))
    pivots = x[rng.choice(2000, 32, replace=False)]
    d = pivot_topk._distances(x, pivots)
    (q, c, s), evaluated = pivot_topk.search_block(np.array([0]), x[:1], d[:1], np.arange(2000), np.arange(2000), x, d, np.array([-np.inf]), 5)
    scores = x @ x[0]
    scores[0] = -np.inf
    assert sorted(s.tolist(), reverse=True) == sorted(scores.tolist(), reverse=True)[:5]
    assert evaluated < 1000


# --- archives


def page_rows():
    long = "<p>" + "x" * 200 + "</p>"
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "é漢" * 60
    return [(5, "http://a/5", long), (3, "http://a/3", long), (9, None, long), (1, "http://a/1", "short"), (2, "http://a/2", "short"), (4, "u\r\nX: y", tricky),
            (6, "http://a/6", None), (7, "http://a/7", ""), (8, "http://a/8", tricky), (9, None, long), (None, "http://a/n", long), (None, "http://a/n", long), (None, "http://a/m", None), (None, None, ""),
            (11, "x", "y" * 100), (12, "x", "y" * 99), (13, "x", "z" * 120), (13, "w", "z" * 120), (None, "q", "v" * 150), (None, "q", "v" * 150)]


def plain_captures(rows):
    """(page_id, bytes, digest, type, refers to) of every row."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1] is not None, rows[r][1] or "", r))
    first, out = {}, []
    for r in order:
        page, _, html = rows[r]
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        revisit = len(payload) >= 100 and digest in first
        out.append((page, len(payload), digest, "revisit" if revisit else "response", first[digest] if revisit else None))
        first.setdefault(digest, page)
    return sorted(out, key=str)


def test_archives_round_trip(spark, monkeypatch):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"kind": F.lit("x"), "payload": F.lit("y"), "occurrence": F.lit(9), "copies": F.lit(4)})
    monkeypatch.setattr(warc, "CLASS_BYTES", 64)  # several size classes
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages.repartition(3), path, records_per_file=4)
    records = warc.read_records(spark, path, keep_payload=True).cache()
    captures = warc.assemble(records).collect()
    assert len(captures) == len(rows)
    pages_of = {c.capture_id: dict((f.key, f.value) for f in c.metadata.fields).get("page-id") for c in captures}
    got = []
    for c in captures:
        fields = dict((f.key, f.value) for f in c.metadata.fields)
        page, sha = pages_of[c.capture_id], hashlib.sha256(bytes(c.response.payload)).hexdigest()
        assert c.request is not None and (c.response.kind == "revisit" or sha == c.response.payload_digest)
        refers = None if c.response.refers_to is None else pages_of[c.response.refers_to]
        got.append((page and int(page), int(fields["payload-length"]), c.response.payload_digest, c.response.kind, refers and int(refers)))
    assert sorted(got, key=str) == plain_captures(rows)
    assert "u%0D%0AX: y" in {c.response.target_uri for c in captures}
    records.unpersist()


def test_large_pages_in_bounded_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 12_000_000)
    rows = [(i, f"http://a/{i}", f"{i} " + "0123456789" * 500_000) for i in range(8)] + [(100 + i, None, "small") for i in range(300)]
    path = scratch_path(spark, "warc-large")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    sizes = [len(gzip.decompress(bytes(f.content))) for f in files]
    assert max(sizes) < 13_000_000 and len(sizes) < 20
    out = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(out) == len(rows) and sum(c.response.kind == "response" for c in out) == len(rows)


def test_parser_takes_records_by_length():
    data = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    out = list(warc.parse_records(io.BytesIO(data)))
    assert [(h["warc-type"], b) for h, b in out] == [("metadata", b"abc"), ("response", b"")]
    assert list(warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data))))) == out
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(data[:60])))


def test_archives_of_no_pages(spark):
    path = scratch_path(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


# --- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == columns, name
        path = scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0.5 * before <= docs.count() <= before
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = cp.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == ids
    again = cp.run(spark, SF_SMALL).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(again) == key(packed)


def test_pipeline_on_no_documents(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF_CHECK)
        assert out.count() == 0
