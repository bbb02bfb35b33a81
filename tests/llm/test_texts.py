"""Language ID, quality, tokenising, packing and personal data: brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raterkit.llm import bpe_tree, grams, language_id, packing, pii_crf, quality

SF_SMALL, SF_CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

ODD = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, d long, words string"


def odd_docs(spark):
    """Nulls, empties, long texts, repeated rows and clashing columns."""
    rows = [
        (1, None, "en", None, None, 1, 0.5, 7, "x"), (2, "", "en", "s", 0, None, None, None, None), (3, "  \n\t ", None, "s", 5, 0, 0.1, 1, ""),
        (4, "The quick brown fox. Mail a.b@c.example.org now!", "en", "s", 48, 1, 0.2, 2, "y"),
        (4, "The quick brown fox. Mail a.b@c.example.org now!", "en", "s", 48, 1, 0.2, 2, "y"),
        (None, "ein kleiner Text über Äpfel", "de", "s", 27, 0, 0.2, 2, "y"), (5, "word " * 30_000, "en", "s", 150_000, 1, 0.2, 2, "y"),
        (6, "a" * 70_000, "en", "s", 70_000, 1, 0.2, 2, "y"), (7, "12345 !!! ...", "en", "s", 13, 1, 0.2, 2, "y"),
        (8, "漢字 и текст \U0001f642 <|endoftext|> 'S it's", None, "s", 30, 1, 0.2, 2, "y"),
    ]
    return spark.createDataFrame(rows, ODD)


# --- grams


def test_span_hashes_depend_on_content_alone():
    a, b = grams.code_points(["one two three", "zero one two three"]), grams.code_points(["x", "two one"])
    hashes = {}
    for points, _ in (a, b):
        for s, e, h in zip(*grams.word_spans(points), grams.span_hashes(points, *grams.word_spans(points))):
            word = "".join(map(chr, points[s:e]))
            assert hashes.setdefault(word, int(h)) == int(h)
    assert len(set(hashes.values())) == len(hashes)


def test_chunks_cover_all_texts():
    texts = ["x" * n for n in (5, 400_000, 0, 10, 300_000)]
    assert [i for lo, hi in grams.chunks(texts) for i in range(lo, hi)] == list(range(5))


# --- language


def test_language_of_held_out_documents(spark):
    out = language_id.op8_language_id(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out and lang is not null").collect()
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_language_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "ab a", "x"), (2, "ba", "y"), (3, "ab", "x"), (4, None, "x"), (5, "zz", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == ["x", "y"]
    size = 1 << language_id.BITS
    counts = [np.zeros(size), np.zeros(size)]
    for text, k in (("ab a", 0), ("ab", 0), ("ba", 1)):
        np.add.at(counts[k], language_id.hashed_grams([text])[0], 1)
    for k in (0, 1):
        want = np.log(counts[k] + language_id.SMOOTHING) - np.log(counts[k].sum() + language_id.SMOOTHING * size)
        assert np.allclose(model.weights[k], want, atol=1e-5)
    one, _ = language_id.hashed_grams(["ab a", "ba"])
    assert np.array_equal(one, np.concatenate([language_id.hashed_grams([t])[0] for t in ("ab a", "ba")]))
    names, scores = model.predict(["ab ab", "", "123", None or ""])
    assert names[0] == "x" and names[1:] == ["und"] * 3 and list(scores[1:]) == [0.0] * 3


def model_keeps(docs, texts):
    """By brute force: whether half of a text's n-grams stand in one of 200 documents of the likeliest language."""
    grams_of = lambda t: language_id.hashed_grams([t])[0].tolist()
    learned = [(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5]
    langs = sorted({x for _, x in learned})
    size, out = 1 << language_id.BITS, []
    for text in texts:
        found = grams_of(text)
        best = None
        for lang in langs:
            own = [grams_of(t) for t, x in learned if x == lang]
            counts = np.bincount([g for o in own for g in o], minlength=size)
            score = np.log((counts[found] + language_id.SMOOTHING) / (counts.sum() + language_id.SMOOTHING * size)).sum() + np.log(len(own))
            share = np.mean([sum(g in set(o) for o in own) >= max(1, language_id.FAMILIAR_DOCS * len(own)) for g in found[:2000]]) if found else 0.0
            if best is None or score > best[0]:
                best = (score, share)
        out.append(bool(found) and best[1] >= language_id.FAMILIAR_GRAMS)
    return out


def test_language_stage_drops_what_the_model_does_not_know(spark):
    r = random.Random(4)
    english, german = "the a plain word of these number lines and some more text is here".split(), "ein kleiner Text über die Äpfel und das Haus ist nicht hier".split()
    rows = [(i, " ".join(r.choice(english) for _ in range(20)), "en") for i in range(60)] + [(60 + i, " ".join(r.choice(german) for _ in range(20)), "de") for i in range(60)]
    odd = [(200, "Αυτό είναι ένα κείμενο", None), (201, "xqzj kvwq zzxq qqjx wvkz", "en"), (202, "the plain words of this text are more than some", None), (203, "das Haus und die Äpfel", "de")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in language_id.language_stage(spark, docs, "").collect()}
    assert {x for x in kept if x < 200} == set(range(120)) and {200, 202, 203} & kept == {202, 203}
    assert (201 in kept) == model_keeps(docs, [odd[1][1]])[0]
    assert {x.doc_id for x in language_id.language_stage(spark, docs, "", ["de"]).collect()} == {*range(60, 120), 203}


def test_language_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    model = language_id.train(docs)
    out = language_id.identify(docs, model, [F.col("doc_id"), F.col("score").alias("old")]).collect()
    und = [r.doc_id for r in out if r.lang_pred == "und"]
    assert len(out) == 10 and sorted(und) == [1, 2, 3, 7]
    kept = language_id.language_stage(spark, docs, "")
    texts = [r.text or "" for r in docs.collect()]
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted(t for t, k in zip(texts, model_keeps(docs, texts)) if k)
    empty = docs.limit(0)
    assert language_id.language_stage(spark, empty, "").count() == 0
    assert language_id.train(empty).predict(["abc"])[0] == ["und"]


def test_language_counts_need_memory_for_few_texts_at_a_time():
    rows = [("ab", f"l{i % 200:03d}") for i in range(5000)] + [("", "en")] * 5000
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [x for _, x in rows]})
    tracemalloc.start()
    found = list(language_id._count_task(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # all 10,000 texts by 2**BITS buckets would be 330 MB
    docs = [(x, n, d) for b in found for x, k, n, d in zip(*(b.column(c).to_pylist() for c in ("lang", "bucket", "n", "docs"))) if k == -1]
    assert sum(n for _, n, _ in docs) == 10_000 and sum(n for x, n, _ in docs if x == "en") == 5000
    counts = np.zeros(1 << language_id.BITS, dtype=np.int64)
    for b in found:
        bucket, n = b.column("bucket").to_numpy(), b.column("n").to_numpy()
        np.add.at(counts, bucket[bucket >= 0], n[bucket >= 0])
    one = language_id.hashed_grams(["ab"])[0]
    assert np.array_equal(counts, 5000 * np.bincount(one, minlength=len(counts)))


def test_language_stage_without_labels(spark):
    docs = odd_docs(spark)
    lettered = sorted(str(r.doc_id) for r in docs.collect() if any(map(str.isalpha, r.text or "")))
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    for languages in (None, ["en"]):  # nothing to learn from
        kept = language_id.language_stage(spark, blank, "", languages)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == lettered
    rows = [(i, f"the plain words number {'abcdefghij'[i % 10]}", "en") for i in range(40)] + [(40 + i, "ein kleiner Text über Äpfel", "de") for i in range(40)]
    two = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang for r in language_id.language_stage(spark, two, "", ["de"]).collect()} == {"de"}
    assert language_id.language_stage(spark, two, "").count() == 80


# --- quality


def test_quality_on_held_out_labels(spark):
    out = quality.op7_quality(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id")
    held = out.where("held_out").collect()
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.9
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.9  # area under the curve


def test_quality_features_against_brute_force():
    texts = ["ab cd ab", "", "x", "x x y y y", "ab cd ab\nlonger text"]
    f = quality.features(texts)
    for i, t in enumerate(texts):
        words = f.words[f.word_starts[i] : f.word_starts[i + 1]]
        parts = t.split()
        assert len(words) == 2 * len(parts)
        repeats = [k > 0 and parts[k] == parts[k - 1] for k in range(len(parts))]
        assert [w == quality.AGAIN % (1 << quality.BITS) for w in words[1::2]] == repeats
        own = f.grams[f.starts[i] : f.starts[i + 1]][f.valid[f.starts[i] : f.starts[i + 1]]]
        assert len(own) == max(0, len(t) - 2)
        alone = quality.features([t])
        assert np.array_equal(alone.words, words) and np.array_equal(alone.grams[alone.valid], own)


def test_quality_scores_equal_the_network(spark):
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.standard_normal(1 << quality.BITS).astype(np.float32), 0.25)
    texts = ["ab cd", "", "longer text here " * 40]
    for t, s in zip(texts, model.score(texts)):
        f = quality.features([t])
        values = [*model.table[f.words], *model.table[f.grams[f.valid]]]
        z = (np.sum(values, dtype=np.float64) / len(values) if values else 0.0) + 0.25
        assert s == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id long, label int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model, [F.col("doc_id"), F.col("label").alias("score_label")]).collect()
    assert len(out) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    none = quality.train(docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in quality.score(docs, none, [F.col("doc_id")]).collect()} == {(0.5, 1)}
    assert quality.score(docs.limit(0), none, [F.col("doc_id")]).count() == 0


# --- byte-pair encoding


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_tree.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_tree_concatenation_equals_the_tokenizer(byte_tokenizer):
    codec = bpe_tree.codec(bpe_tree.default_vocabulary())
    r = random.Random(3)
    letters = [list("aeinstrhl  \n'.,!0123é漢\U0001f642\xa0") + ["<|endoftext|>", "'s", "'re", "the", "ing"], list("aeinstr'.!01é漢"), "a", "ab", "the ", "=-"]
    for n in range(1500):
        text = "".join(r.choice(letters[n % 6]) for _ in range(r.randint(0, 400)))
        leaf = r.choice((1, 2, 5, 30, 100))
        parts = [codec.encode(text[i : i + leaf]) for i in range(0, len(text), leaf)]
        while len(parts) > 1:
            parts = [codec.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        ids = parts[0] if parts else np.zeros(0, "<u4")
        want = byte_tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert codec.decode(ids) == byte_tokenizer.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("leaf", [7, 5000, bpe_tree.LEAF])
def test_encode_equals_the_tokenizer(spark, byte_tokenizer, leaf):
    docs = odd_docs(spark)
    if leaf == 7:
        docs = docs.where("n_chars < 100 or n_chars is null")
    rows = docs.select("doc_id", "text").collect()
    want = sorted(
        (str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for d, t in rows for ids in [byte_tokenizer.encode(t or "", add_special_tokens=False).ids]
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.encode(docs, leaf=leaf).collect())
    assert got == want
    assert bpe_tree.encode(docs.limit(0), leaf=leaf).count() == 0


# --- packing


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    encoder = packing.WordEncoder(packing.default_vocabulary(), most=50)
    r = random.Random(5)
    letters = list("aAeEzZ09 .,'!?<|>\n\t_-@éÉßÿ÷×µªº²½\x1c\x85\xa0́œΣİßǅ漢字\U0001f642strevmld") + ["<|endoftext|>", "'s", "'re", "the"]
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 20)))
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def check_packing(rows, size):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_plan_places_every_piece_once():
    r = random.Random(2)
    for trial in range(40):
        size = r.choice((8, 64, 1000))
        lengths = [r.randint(1, size) if trial % 2 else min(size, int(r.paretovariate(1.0))) for _ in range(r.randint(0, 400))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        slots = packing.plan(histogram, size)
        used, room = {}, {}
        for s in slots:
            assert s.first == used.get(s.length, 0)
            used[s.length] = s.first + s.copies * s.sequences
            for k in range(s.sequences):
                room.setdefault(s.sequence + k, []).append((s.offset, s.copies * s.length))
        assert used == histogram
        for places in room.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size
        if lengths and trial % 2 == 0:  # many short pieces: no more than one sequence over the bound
            assert len(room) <= -(-sum(lengths) // size) + 1 + sum(x > size // 2 for x in lengths)


@pytest.mark.parametrize("counts, size, sequences", [({6: 1, 4: 1}, 10, 1), ({5: 2, 3: 1, 2: 1}, 10, 2), ({7: 1, 1: 3}, 10, 1), ({5: 4}, 10, 2), ({}, 10, 0), ({10: 3}, 10, 3)])
def test_plan_finds_exact_combinations(counts, size, sequences):
    slots = packing.plan(counts, size)
    assert max((s.sequence + s.sequences for s in slots), default=0) == sequences


def test_words_remembered_are_bounded_in_bytes():
    made = []
    kept = packing.Recent(lambda k: made.append(k) or len(k), 100)
    for _ in range(2):
        assert [kept["x" * n] for n in (5, 64, 65, 1_000_000)] == [5, 64, 65, 1_000_000]
    assert sorted(map(len, made)) == [5, 64, 65, 65, 1_000_000, 1_000_000] and sum(map(len, kept)) == 69


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), allowMissingColumns=True)
    rows = packing.pack(docs).collect()
    want = []
    for d in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((str(d.doc_id), k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    total = sum(w[3] for w in want)
    assert check_packing(rows, 4096) <= -(-total // 4096) + 1
    assert packing.pack(docs.limit(0)).count() == 0


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            ):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_equal_the_patterns():
    r = random.Random(7)
    pieces = list("ab.@-+%_ ()\n0123456789é") + ["a@b.c", "1.2.3.4", "+1 (555) 010-9999", "4111111111111111", "4111 1111 1111 1111", "@", "..", "256.1.1.1", "00012"]
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 18)))
        assert pii_crf.base_spans(text) == plain_spans(text), repr(text)


def test_base_spans_are_linear_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a." * 150_000 + "@", "+1" * 100_000):
        pii_crf.base_spans(text)


def test_decoding_equals_plain_viterbi():
    rng = np.random.default_rng(4)
    field = pii_crf.Field(rng.standard_normal((5, pii_crf.SHAPES, pii_crf.LABELS)), rng.standard_normal((pii_crf.LABELS,) * 2))
    field.emit[:, :, 0] += 0.6
    text = "Mail bob@x.org or\n+1 555 010 12\n\nplain words only here\n" * 4 + "10.0.0.300 end"
    points, _ = grams.code_points([text])
    t = pii_crf.tokens(points)
    got, rule = field.decode(t), pii_crf._allowed()
    bounds = [*t.lines.tolist(), len(t.shapes)]
    for lo, hi in zip(bounds, bounds[1:]):
        scores = np.zeros((hi - lo, pii_crf.LABELS))
        for i in range(hi - lo):
            for k, o in enumerate(pii_crf.OFFSETS):
                shape = t.shapes[lo + i + o] if 0 <= i + o < hi - lo else pii_crf._BEYOND
                scores[i] += field.emit[k, shape]

        def total(path):
            s = sum(scores[i, y] for i, y in enumerate(path)) + (-1e4 if path[0] and path[0] % 2 == 0 else 0)
            return s + sum(field.move[a, b] + rule[a, b] for a, b in zip(path, path[1:]))

        value, paths = {y: (scores[0, y] + (-1e4 if y and y % 2 == 0 else 0), [y]) for y in range(pii_crf.LABELS)}, None
        for i in range(1, hi - lo):
            value = {
                y: max(((v + field.move[x, y] + rule[x, y] + scores[i, y], [*p, y]) for x, (v, p) in value.items()), key=lambda z: z[0])
                for y in range(pii_crf.LABELS)
            }
        best = max(v for v, _ in value.values())
        assert total(got[lo:hi].tolist()) == pytest.approx(best, abs=1e-6)


MISSED = {
    "(555) 123-4567": "phone", "tel. 020 7946 0958": "phone", "john.doe at example dot com": "email", "4111 1111 1111 1112": "card",
    "server at 10.0.0.300": "ip", "erat the 10.20.30.400 then on": "ip", "please call 0171 555 019 or write": "phone",
}


def test_field_adds_forms_that_the_patterns_miss():
    field = pii_crf.train()
    for text, kind in MISSED.items():
        base, added = pii_crf.find_spans([text], field)[0]
        assert base == [] and [k for _, _, k in added] == [kind], text
    assert [text[s:f] for text in ["Mail to john.doe at example dot com, thanks"] for s, f, _ in pii_crf.find_spans([text], field)[0][1]] == ["john.doe at example dot com"]
    clean = ["The plain words of a clean text, with 3 numbers and 2024 dates.", "Another line.\nAnd 15 more.", "on 2024-01-15 at 10:30 we paid $1,299.00", "version 1.2.3 of it",
             "meet me at home and look at dot matrix 1234", "isbn 978-3-16-148410-0", "1 2 3 4 5 6 7 8 9 0", "2001 2002 2003", "a table 12 345 678 9", "the dot at the end of 1999"]
    for text, (base, added) in zip(clean, pii_crf.find_spans(clean, field)):
        assert base == added == [], text


def test_field_leaves_documents_alone(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("text").collect()]
    found = pii_crf.find_spans(texts, pii_crf.train())
    held = [(t[s:f], k) for t, (_, added) in zip(texts, found) for s, f, k in added]
    assert all(sum(c.isdigit() for c in t) >= 7 for t, _ in held) and len(held) <= 10
    for text in texts[:200]:  # each line on its own gives the same
        whole = pii_crf.find_spans([text], pii_crf.train())[0][1]
        at, lines = 0, []
        for line in text.split("\n"):
            lines += [(s + at, f + at, k) for s, f, k in pii_crf.find_spans([line], pii_crf.train())[0][1]]
            at += len(line) + 1
        assert whole == lines


def test_field_on_one_very_long_line():
    text = "call (555) 123-4567 " + "1 22 333 4444 " * 60_000 + " or (555) 123-4567"
    base, added = pii_crf.find_spans([text], pii_crf.train())[0]
    assert (5, 19, "phone") in added and (len(text) - 14, len(text), "phone") in added


def test_pii_lines_without_digits_or_marks():
    field = pii_crf.train()
    for text, span in (("john.doe at example.com", "john.doe at example.com"), ("see\nmail anna (at) firm.org", "anna (at) firm.org"), ("anna(at)firm.org", "anna(at)firm.org")):
        added = pii_crf.find_spans([text], field)[0][1]
        assert [text[s:f] for s, f, kind in added if kind == "email"] == [span], text
    # words with stops are no address without an @ or an at, however many
    for text in ("shnd. " * 40 + "ninou oninou", "Des. Des. Sur, Sur, " * 20):
        assert pii_crf.find_spans([text], field)[0] == ([], [])


def test_pii_query_and_odd_rows(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), allowMissingColumns=True)
    out = pii_crf.find(docs, pii_crf.train()).collect()
    texts = [(str(r.doc_id), r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = sorted((d, *[sum(k == kind for _, _, k in plain_spans(t)) for kind in PATTERNS],
                   hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in plain_spans(t)).encode()).hexdigest()) for d, t in texts)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
    assert all(r.spans.count(":") == 2 * (r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added) for r in out)
    assert all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added for r in out)
    assert pii_crf.find(docs.limit(0), pii_crf.train()).count() == 0
    stage = pii_crf.pii_stage(spark, docs, "")
    assert stage.columns == docs.columns and stage.count() == docs.count()
    redacted = stage.where("doc_id = 4").first()
    assert redacted.text == "The quick brown fox. Mail [EMAIL] now!" and redacted.n_chars == len(redacted.text)
    assert stage.where("doc_id = 1").first().text is None
    assert not [r for r in stage.select("text").collect() if r.text and plain_spans(r.text)]
