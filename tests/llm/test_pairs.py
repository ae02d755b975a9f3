"""Hard negatives, tokenizer alignment and substring dedup against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.llm import alignment, hard_negatives, substring_dedup


def order_key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


# Substring dedup


def brute_kept(rows, window):
    """rows: (id, text), in any order. Result by (id, text)."""
    docs = {(i is None, i or 0, "" if t is None else t): (t or "").encode().split() for i, t in rows}
    hashed = sorted(docs, key=lambda k: k[:2])
    seen, gone = set(), {}
    for k in hashed:
        words, mine = docs[k], set()
        for at in range(len(words) - window + 1):
            w = tuple(words[at : at + window])
            if w in seen:
                mine.update(range(at, at + window))
            seen.add(w)
        gone[k] = mine
    out = []
    for i, t in rows:
        k = (i is None, i or 0, t or "")
        kept = [w for n, w in enumerate(docs[k]) if n not in gone[k]]
        out.append((i, len(docs[k]), len(gone[k]), b" ".join(kept)))
    return sorted(out, key=order_key)


@pytest.mark.parametrize(("run", "bucket"), [(1_000_000, 800_000), (60, 40)])
def test_kept_text_equals_brute_force(documents, words, monkeypatch, run, bucket):
    """Also with runs and buckets of a few documents."""
    monkeypatch.setattr(substring_dedup, "RUN", run)
    monkeypatch.setattr(substring_dedup, "BUCKET", bucket)
    passage, edge, draw = words(40), words(20), random.Random(2)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, words(19)), (4, edge), (5, f"{words(7)} {edge}"), (6, "a " * 60), (7, "b a " * 40), (8, words(400) + " " + passage)]
    for n in range(9, 40):  # a hot passage, once with a changed word
        cut = passage.split()
        if n % 5 == 0:
            cut[draw.randrange(40)] = "changed"
        rows.append((n, f"{words(draw.randint(0, 9))}\x0b{' '.join(cut)}  {words(draw.randint(0, 30))}"))
    copy = words(120)
    rows += [(n, copy) for n in range(50, 60)] + [(60, copy + " tail"), (61, copy[3:])]
    rows += [(70, copy), (70, copy), (None, copy), (None, copy)]
    docs = documents(*rows).withColumn("document", F.lit(1)).withColumn("places", F.lit("mine")).repartition(5)
    out = substring_dedup.kept_texts(docs)
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in out.collect()]
    assert sorted(got, key=order_key) == brute_kept(rows, 20)


def test_one_id_with_several_texts(documents, words):
    """Documents that share an id are told apart by their texts: what both hold goes from one of them."""
    shared = words(30)
    out = substring_dedup.kept_texts(documents((1, f"x {shared}"), (1, f"y {shared}"))).collect()
    assert sorted(r.n_removed for r in out) == [0, 30]


def test_passages_are_maximal(documents, words):
    shared, more = words(25), words(30)
    rows = [(1, f"{shared} {more}"), (2, f"q {shared} r {more} s"), (3, f"t {shared} {more}")]
    found = {(r.doc_id, r.start, r.stop): r.passage for r in substring_dedup.repeated_passages(documents(*rows)).collect()}
    assert found == {(2, 1, 26): shared, (2, 27, 57): more, (3, 1, 56): f"{shared} {more}"}


def test_substring_dedup_without_broadcast_and_without_rows(documents, words, monkeypatch):
    assert substring_dedup.kept_texts(documents()).count() == 0
    monkeypatch.setattr(substring_dedup, "is_small", lambda df: False)
    text = words(50)
    out = substring_dedup.kept_texts(documents((2, text), (1, text), (3, None))).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 50, 3: 0}


def test_very_long_text(documents, words):
    text = words(30_000)
    out = substring_dedup.kept_texts(documents((1, text), (2, f"{text} more"))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in out} == {1: (30_000, 0), 2: (30_001, 30_000)}


# Tokenizer alignment


def tokens_of(text):
    """Ids and bytes of both sides, by the libraries and files that the contract names."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from ticketlake.llm.packing import byte_characters

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = byte_characters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if text and whole == b"".join(bytes_a) == b"".join(bytes_b) else ([], [], [], [])


def brute_alignment(rows):
    documents, counts = [], Counter()
    for doc, text in rows:
        ids_a, bytes_a, ids_b, bytes_b = tokens_of(text or "")
        spans = lambda parts: [(sum(map(len, parts[:n])), sum(map(len, parts[: n + 1]))) for n in range(len(parts))]
        spans_a, spans_b = spans(bytes_a), spans(bytes_b)
        links = [(i, j) for i, x in zip(ids_a, spans_a) for j, y in zip(ids_b, spans_b) if max(x[0], y[0]) < min(x[1], y[1])]
        cuts = [0, *sorted({x[1] for x in spans_a} & {y[1] for y in spans_b})]
        inside = lambda ids, spans, low, high: ",".join(str(i) for i, s in zip(ids, spans) if low <= s[0] and s[1] <= high)
        groups = [inside(ids_a, spans_a, *c) + "|" + inside(ids_b, spans_b, *c) for c in zip(cuts, cuts[1:])]
        counts.update(set(links))
        documents.append((doc, len(ids_a), len(ids_b), groups, links))
    highest = Counter()
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return sorted(((d, a, b, len(g), len(x), sum(counts[p] == highest[p[0]] for p in x), sum(counts[p] for p in x), digest(g)) for d, a, b, g, x in documents), key=order_key), counts


@pytest.mark.parametrize(("run", "fan"), [(6_000_000, 64), (400, 2)])
def test_alignment_equals_brute_force(documents, words, monkeypatch, run, fan):
    """Also with many short runs, which are merged level by level."""
    monkeypatch.setattr(alignment, "RUN", run)
    monkeypatch.setattr(alignment, "FAN", fan)
    texts = [None, "", " ", "  two  spaces ", "a▁b", "naïve café — 東京 🙂", "<|endoftext|> </s> <0x41>", "line\r\nend\t\x00", "x" * 300, "copy of this", "copy of this"]
    rows = list(enumerate([*texts, *(words(random.Random(n).randint(1, 40)) for n in range(20))])) + [(None, "no id"), (9, "copy of this")]
    docs = documents(*rows).withColumn("run", F.lit(1)).withColumn("radix", F.lit("mine")).repartition(3)
    a, b, size_b = alignment.sides()
    runs = alignment.alignment_runs(docs, a, b)
    expected, counts = brute_alignment(rows)
    assert sorted((tuple(r) for r in alignment.aligned(runs, size_b).collect()), key=order_key) == expected
    assert {(r.a, r.b): r.documents for r in alignment.pair_counts(runs, size_b).collect()} == counts


def test_alignment_of_no_rows(documents):
    a, b, size_b = alignment.sides()
    assert alignment.aligned(alignment.alignment_runs(documents(), a, b), size_b).count() == 0


def test_heap_merge_adds_up_equal_pairs():
    run = lambda *entries: alignment._packed(np.array(entries, dtype=np.int64))
    assert alignment.merge_runs([run((1, 2), (5, 1)), run((1, 3)), run((4, 9), (5, 1))]).tolist() == [[1, 5], [4, 9], [5, 2]]


def test_groups_as_text(documents):
    a, b, _ = alignment.sides()
    out = {r.doc_id: r.groups for r in alignment.aligned_groups(documents((1, "copy"), (2, None)), a, b).collect()}
    assert hashlib.sha256(out[1].encode()).hexdigest() == brute_alignment([(1, "copy")])[0][0][-1] and out[2] == ""


# Hard negatives


def brute_negatives(rows, every, k):
    usable = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        usable[i] = min(usable.get(i, row), row)
    sizes = Counter(len(v) for _, v in usable.values())
    size = min(sizes, key=lambda n: (-sizes[n], n), default=0)
    usable = {i: r for i, r in usable.items() if len(r[1]) == size}
    out = []
    for a, (label, q) in usable.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in usable.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p][:k]
            out += [(a, positive, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fits)]
    return sorted(out)


EMBEDDING = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [4096, 24])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    """Clusters, copies, ties and rows that take no part; also in many small blocks with small leaves."""
    for name, value in {"BLOCK": block, "LEAF": 4, "GROUP": 3, "TOGETHER": 2, "SHELF": 5, "CENTRES": 12}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((6, 8))
    rows = [(int(n), (centres[n % 6] + draw.standard_normal(8) * [0.05, 0.6][n % 2]).astype(np.float32).tolist(), int(draw.integers(0, 4))) for n in range(300)]
    rows += [(n, rows[0][1], n % 3) for n in range(300, 360)]  # copies of a vector
    rows += [(400, None, 1), (405, rows[1][1], None), (None, rows[1][1], 1), (410, [float("nan")] * 8, 1), (415, [None] + [0.5] * 7, 2), (420, [1.0] * 5, 1), (425, [0.0] * 8, 1)]
    rows += [rows[10], rows[20], (20, rows[21][1], 9)]  # repeated ids
    frame = spark.createDataFrame(rows, EMBEDDING).withColumn("score", F.lit("mine")).repartition(4)
    out = hard_negatives.hard_negatives(frame, every=5)
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows, 5, 5)


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e6, 2e6], 1), (1, [1e6, 1e6], 1), (2, [0.9e6, 1e6], 2), (3, [-1e6, 1.0], 2), (5, [1e6, 0.8e6], 3), (6, [1e38, 1.0], 4)]
    out = hard_negatives.hard_negatives(spark.createDataFrame(rows, EMBEDDING), every=100)
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows, 100, 5)  # the last scores more than a positive, so its size plays no part
    assert hard_negatives.hard_negatives(spark.createDataFrame([], EMBEDDING)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], EMBEDDING)).count() == 0


def test_runs_are_aligned_a_slice_at_a_time(monkeypatch):
    a, b, _ = alignment.sides()
    aligner = alignment.Aligner(alignment.Side(*a), alignment.Side(*b))
    texts = ["one two three", "", "é" * 50, "four five", "word " * 300, "six"]
    whole, sizes, align = aligner.align(texts), [], aligner.align
    monkeypatch.setattr(alignment, "SLICE", 200)
    monkeypatch.setattr(aligner, "align", lambda part: sizes.append(len(part)) or align(part))
    sliced = aligner.align_run(texts)
    assert len(sizes) > 1 and sum(sizes) == len(texts)
    assert (sliced["figures"] == whole["figures"]).all() and all((x == y).all() for x, y in zip(sliced["links"], whole["links"]))
    assert sliced["digests"] == b"".join(hashlib.sha256(g.encode()).digest() if g else bytes(32) for g in whole["groups"])
