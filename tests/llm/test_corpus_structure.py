"""Phrase collocations and shards, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from raterkit.llm import collocations, sharding

# --- phrases


def plain_collocations(docs, least, reported):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    f = {x: c for x, c in f.items() if c >= least}
    held = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        longer = [b for (o, v), b in f.items() if o == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        held[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for lang, v in held.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:reported], 1)}


def found_phrases(spark, docs, least, reported):
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({"word": F.lit(3), "phrase": F.lit("x"), "kind": F.lit("words"), "id": F.lit(1)})
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, least, reported).collect()}


def test_collocations_against_brute_force(spark, monkeypatch):
    r = random.Random(12)
    vocabulary = ["a", "b", "C", "é", "É", "of", "the", "x y", " ", "z'"]
    gaps = [" ", " ", " ", "\t ", "  ", ", ", ".", "\n", "\r\n", "?!", "\x0b", "\x85"]
    docs = [(r.choice(["en", "fr", None, "und"]), "".join(r.choice(vocabulary[: r.choice((3, 10))]) + r.choice(gaps) for _ in range(r.randint(0, 30)))) for _ in range(150)]
    docs += [("en", None), (None, None), ("en", ""), ("de", " \t.,"), ("de", "only once said"), ("fr", "the same row again and again, the same row")] + [("fr", "one two three four five six seven")] * 9
    for size in (50, 1 << 21):
        monkeypatch.setattr(collocations, "WORDS_HELD", size)
        assert found_phrases(spark, docs, 4, 25) == plain_collocations(docs, 4, 25)


def test_collocations_of_little(spark):
    assert found_phrases(spark, [], 2, 10) == {} and found_phrases(spark, [(None, None), ("en", "a b c")], 2, 10) == {}
    assert found_phrases(spark, [("en", "b a, " * 3)], 3, 10) == {("en", 1): ("b a", 3, 3, 3, 6, 2000)}


def test_scores_pass_64_bits(spark):
    expr = "(cast(1000 as decimal(4, 0)) * cast(9000000000000 as decimal(20, 0)) * cast(70000000000000 as decimal(20, 0))) div (cast(9000000000001 as decimal(20, 0)) * cast(9000000000007 as decimal(20, 0)))"
    assert spark.range(1).select(F.expr(expr)).first()[0] == 1000 * 9000000000000 * 70000000000000 // (9000000000001 * 9000000000007)


def test_words_let_through_in_error_change_nothing(spark, monkeypatch):
    docs = [("en", f"a b c{i % 3} a b d{i}, a b") for i in range(12)]
    monkeypatch.setattr(collocations, "BITS", 64)
    assert found_phrases(spark, docs, 4, 50) == plain_collocations(docs, 4, 50)


# --- shards


def plain_place(vectors, shards):
    left = [[1.0 / shards] * vectors.shape[1] for _ in range(shards)]
    out = {}
    for i in sorted(range(len(vectors)), key=lambda i: -max(vectors[i])):
        room = [[x - v for x, v in zip(s, vectors[i])] for s in left]
        dots = [sum(x * v for x, v in zip(s, vectors[i])) for s in left]
        fits = [s for s in range(shards) if min(room[s]) >= -1e-12]
        best = max(fits, key=lambda s: (dots[s], -s)) if fits else max(range(shards), key=lambda s: (min(room[s]), -s))
        left[best], out[i] = room[best], best
    return [out[i] for i in range(len(vectors))]


def test_placing_against_brute_force():
    r = np.random.default_rng(4)
    for n in (0, 1, 7, 60):
        v = r.integers(1, 50, (n, 3)) / 64.0
        v = np.round(v / np.maximum(1, np.ceil(v.sum(axis=0))) * 64) / 64
        assert sharding.place(v, 4).tolist() == plain_place(v, 4)


def checked(rows, docs, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return slots


def test_shards_of_skewed_documents(spark):
    r = random.Random(13)
    docs = [(i, "".join(r.choice("ab é\n") for _ in range(min(4000, int(r.paretovariate(0.9) * 20))))) for i in range(2500)]
    docs += [(i, "the same text in a third of all rows") for i in range(3000, 4200)] + [(None, None)] * 5 + [(7, ""), (None, "x"), (7, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit(0), "row": F.lit("r"), "size": F.lit(1), "a": F.lit(2)})
    rows = sharding.sharded(df, 8).collect()
    slots = checked(rows, docs, 8)
    sizes = Counter()
    for x in rows:
        sizes[x.shard] += x["size"]
    mean = sum(sizes.values()) / 8
    assert all(abs(s - mean) < 0.01 * mean for s in sizes.values())
    assert all(abs(len(s) - len(docs) / 8) < 0.1 * len(docs) / 8 for s in slots.values())
    of_text = defaultdict(set)
    texts = {i: t for i, t in docs if i is not None}
    for x in rows:
        if x.doc_id is not None and x.doc_id < 3000 and x.doc_id != 7:
            of_text[texts[x.doc_id]].add(x.shard)
    assert all(len(s) == 1 for t, s in of_text.items() if len(t) < 300)


def test_shards_of_little(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.sharded(df).count() == 0
    for docs in ([(1, None)], [(None, None), (None, ""), (3, "a"), (3, "a")]):
        checked(sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, 16)


def test_shards_of_documents(spark):
    out = sharding.op13_sharding(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sizes = [r["size"] for r in out.groupBy("shard").agg(F.sum("size").alias("size")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.02 * sum(sizes) / 16


def test_collocations_leave_no_bit_table_behind(spark):
    import os

    from raterkit.llm.collocations import frequent_phrases

    def kept() -> int:
        at = spark.sparkContext._temp_dir
        return sum(os.path.getsize(os.path.join(at, f)) for f in os.listdir(at))

    docs = spark.createDataFrame([(i, "en", "one two three four") for i in range(3)], "doc_id long, lang string, text string")
    before = kept()
    every, _ = frequent_phrases(docs, 3)
    assert kept() - before < 1 << 24  # a table is as large
    assert {(r.phrase, r.f) for r in every.where("words = 4").collect()} == {("one two three four", 3)}


def test_counts_pass_between_tasks_in_blocks():
    r = np.random.default_rng(5)
    vocabulary = r.integers(-(1 << 62), 1 << 62, 40_000)
    texts, least = [vocabulary[np.minimum(r.zipf(1.3, 60_000), 40_000) - 1] for _ in range(4)], 100
    tasks = [collocations.SlotCounts(1 << 20, least, 25_000) for _ in texts]
    rows = [b for x, t in zip(tasks, texts) for own in (x.add(t[:30_000]), x.add(t[30_000:]), x.rest()) for b in own]
    assert all(b.num_rows <= (1 << 20) // collocations.BLOCK for b in rows)  # not a row for each word and task
    found = set()
    for block in range((1 << 20) // collocations.BLOCK):
        own = [b.filter(np.asarray(b.column("block")) == block) for b in rows]
        for out in collocations._often_in_block(least)(iter(own)):
            for at, bits in zip(out.column("at").to_pylist(), out.column("bits").to_pylist()):
                found |= {64 * at + k for k in range(64) if bits >> k & 1}
    slots = Counter((np.concatenate(texts) & ((1 << 20) - 1)).tolist())
    assert found == {s for s, n in slots.items() if n >= least} and found


def test_phrases_of_many_tasks_are_summed_in_parts():
    r = np.random.default_rng(6)
    prefix, word = r.integers(0, 30, 5000), r.integers(0, 30, 5000)
    tasks = [collocations._summed([(prefix[i : i + 500], word[i : i + 500], np.ones(500, dtype=np.int64))]) for i in range(0, 5000, 500)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "phrase": [p], "last": [w], "count": [n]}) for p, w, n in tasks]
    want = {x: n for x, n in Counter(zip(prefix.tolist(), word.tolist())).items() if n >= 7}
    for most in (1, 1 << 20):
        (out,) = collocations._frequent_in_part(most, 7)(iter(batches))
        assert {(x["prefix"], x["word"]): x["f"] for x in out.to_pylist()} == want


def test_counts_by_slot_take_little_room():
    r = np.random.default_rng(7)
    slots, least = 1 << 20, 300
    ids = [np.concatenate((r.integers(-(1 << 62), 1 << 62, 4000), np.arange(k, k + 2), np.full(200, 77))) for k in range(10)]
    held = collocations.SlotCounts(slots, least, 1 << 21)
    rows = [b for own in ids for b in held.add(own)] + list(held.rest())
    distinct = Counter((np.concatenate(ids) & (slots - 1)).tolist())
    assert sum(b.get_total_buffer_size() for b in rows) < 2.5 * len(distinct)  # a slot's distance and its count: not 6 bytes
    found = {}
    for row in (x for b in rows for x in b.to_pylist()):
        at = row["block"] * collocations.BLOCK + np.cumsum(collocations._unpacked(row["slots"]))
        found.update(zip(at.tolist(), collocations._unpacked(row["counts"]).tolist(), strict=True))
    assert found == {s: min(n, least) for s, n in distinct.items()} and found[77] == least


def test_words_that_are_not_frequent_are_not_written(spark, monkeypatch):
    import os

    from raterkit.session import ensure_checkpoint_dir

    def written() -> int:
        at = ensure_checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at) for f in names)

    monkeypatch.setattr(collocations, "BITS", 1 << 22)
    docs = [(i, "en", " ".join(f"w{i}x{k}" for k in range(1000)) + ". one two three") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(2)
    before = written()
    every, totals = collocations.frequent_phrases(df, 150)
    assert written() - before < 4 * 200_000  # a hash for each word is 8
    assert {(r.phrase, r.f) for r in every.collect()} == {(p, 200) for p in ("one", "two", "three", "one two", "two three", "one two three")}
    assert totals.first().n == 200 * 1003


def test_neighbours_stay_neighbours():
    r = np.random.default_rng(8)
    for _ in range(200):
        run = r.integers(0, 4, r.integers(0, 30))
        keep = r.random(np.count_nonzero(run)) < 0.6
        left = run.copy()
        left[np.flatnonzero(run)[~keep]] = 0
        pairs = [[(a, b) for a, b in zip(x.tolist(), x[1:].tolist()) if a and b] for x in (left, collocations._side_by_side(run, keep))]
        assert pairs[0] == pairs[1] and len(collocations._side_by_side(run, keep)) <= 3 * len(pairs[0])
