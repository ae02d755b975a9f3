"""Exact dedup, near duplicates, mixing, packing and the pipeline."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticketlake.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from ticketlake.llm.common import with_row_number


def test_exact_dedup_keeps_longest_original_then_least_id(documents):
    docs = documents((5, "a b"), (3, "ab"), (4, "a  b"), (2, "a \tb"), (9, None), (8, ""), (7, " \n"), (1, "other"), (1, "other"), (None, "ab"))
    out = [r.asDict() for r in exact_dedup.exact_dedup(docs).collect()]
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 10
    assert {by[i]["keep_id"] for i in (5, 3, 4, 2, None)} == {2} and by[4]["group_size"] == 5
    assert [by[i]["keep_id"] for i in (7, 8, 9)] == [7, 7, 7]
    assert by[1]["group_size"] == 2 and by[1]["kept"]
    assert by[3]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs.withColumn("kept", F.lit("mine")))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7] and kept.columns[-1] == "kept"


def test_exact_dedup_without_broadcast(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "is_small", lambda df: False)
    docs = documents((1, "x y z" * 50), (2, "xyz" * 50), (3, "x"), (4, "y"))
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def brute_components(rows, width, percent):
    sets = {}
    for doc, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
        sets[doc] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    up = {d: d for d in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("shard", [2_000_000, 60])
def test_links_equal_brute_force(documents, words, monkeypatch, shard):
    """Also with shards far smaller than a group, so that leaders and visits have to tie them."""
    monkeypatch.setattr(ngram_join, "SHARD", shard)
    monkeypatch.setattr(ngram_join, "BLOCK", 200)
    monkeypatch.setattr(ngram_join, "VISITS", 3)
    passage, rows = words(25), [(0, None), (1, ""), (2, "one two"), (3, "One TWO"), (4, "one"), (5, "é É x y"), (6, "é é x y")]
    for group in range(6):
        base = words(40).split()
        for copy in range(12):
            changed = list(base)
            for n in range(copy % 4):
                changed[(7 * copy + 3 * n + group) % 40 if group % 2 else 39 - n] = f"new{copy}"
            rows.append((len(rows), " ".join(changed).upper() if copy == 3 else " ".join(changed)))
    rows += [(len(rows) + n, f"{passage} {words(8)}") for n in range(20)]
    rows += [(500, rows[20][1]), (501, rows[20][1].replace(" ", "\n"))]
    out = ngram_join.linked_documents(documents(*rows, (None, "one two")).withColumn("node", F.lit(1)))
    expected = brute_components(rows, 4, 85)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert found.pop(None) == (1, None)
    assert found == expected


def test_one_document_of_each_component_stays(documents, words):
    text = words(60)
    other = words(50)
    docs = documents((3, text), (2, text + " more"), (9, other), (9, "again"), (None, text), (None, words(40)))
    kept = ngram_join.drop_near_duplicates(docs.withColumn("row", F.lit(1))).collect()
    # Rows of one id, and rows without one, are rows of their own.
    assert sorted((r.doc_id or 0) for r in kept) == [0, 2, 9, 9]
    assert {r.text for r in kept if r.doc_id == 9} == {other, "again"}


def test_rows_are_numbered_whatever_their_ids(documents):
    docs = documents((5, "a"), (5, "b"), (None, "c"), (None, "c"), (7, "d"))
    numbered = {(r.doc_id, r.text): r.row for r in with_row_number(docs, "row", "doc_id", "text").collect()}
    assert numbered[7, "d"] == 7 and numbered[5, "a"] < numbered[5, "b"] < numbered[None, "c"]
    far = documents(((1 << 63) - 1, "a"), (1, "b"), (1, "c"))
    assert len({r.row for r in with_row_number(far, "row").collect()}) == 3


def test_exact_duplicates_go_by_rows(documents):
    docs = documents((1, "clean words here"), (1, "other clean words"), (2, "cleanwordshere"), (None, "no id"), (None, "no id"), (4, "x  y"), (4, "x y "), (6, None), (7, " "))
    docs = docs.withColumn("found", F.lit(1)).withColumn("sha", F.lit("s"))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    # Of equal rows in id and length the least text stays; the blank text is longer than none.
    expected = [(1, "clean words here"), (1, "other clean words"), (4, "x  y"), (7, " "), (None, "no id")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_toxic_rows_go_by_their_texts(spark, documents, words):
    texts = [words(30) + (" idiot" if n % 3 == 0 else "") for n in range(300)]
    labels = spark.createDataFrame([(n, int(n % 3 == 0)) for n in range(300)], "doc_id long, toxic int")
    more = [(None, words(20) + " idiot"), (None, words(20)), (1, words(20) + " idiot"), (900, None)]
    kept = toxicity.drop_toxic(documents(*enumerate(texts), *more), labels).collect()
    assert not any("idiot" in (r.text or "") for r in kept) and len(kept) == 200 + 2


def test_targets_are_shared_until_none_is_above(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 300), ("a", 5)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sizes).collect()}
    # Weights in order of the source: 5, 2, 1, and 5 for null.
    assert got["a"] == (15, 30.0) and got[None] == (300, 600.0)
    left = 1.5 * 1815 - 630
    assert got["b"] == (1000, pytest.approx(left * 2 / 3)) and got["c"] == (500, pytest.approx(left / 3))


def test_mix_meets_targets_and_reruns_agree(documents, words):
    rows = [(n, words(n % 37 + 1), f"s{n % 3}") for n in range(600)] + [(1000, None, None), (1001, " ", None), (1002, "x", None)]
    docs = documents(*rows).withColumn("taken", F.lit("x"))
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 37 for s in target)
    assert sorted(map(str, out)) == sorted(str(r.asDict()) for r in mixing.mix(docs.repartition(7)).collect())
    copies = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert copies == {r["doc_id"]: r["copies"] for r in out if r["copies"]}


@pytest.mark.parametrize("key", [None, 4])
def test_rows_that_share_an_id_are_mixed_one_by_one(documents, words, key):
    rows = [(key, words(n % 9 + 1), f"s{n % 2}") for n in range(300)] + [(n, words(5), "s0") for n in range(10, 40)]
    docs = documents(*rows).withColumn("times", F.lit(1)).withColumn("row", F.lit(2))
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 9 for s in target)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    assert sorted(map(str, out)) == sorted(str(r.asDict()) for r in mixing.mix(docs.repartition(7)).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_pieces_are_the_tokenizers_and_sequences_have_no_gaps(spark, documents, words):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [words(n * 13 % 500) for n in range(60)] + [None, "", "Don't STOP<|endoftext|>now é\x1cx ñ 12,5 字", words(3000)]
    rows = [*enumerate(texts), (0, texts[0])]
    out = packing.packed_documents(documents(*rows), path).collect()
    again = sorted(map(str, packing.packed_documents(documents(*rows), path).collect()))
    assert [str(r).split("sequence_id")[0] for r in sorted(out, key=str)] == [a.split("sequence_id")[0] for a in again]
    pieces, places = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for doc, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected = [(n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
        assert sorted(set(pieces[doc])) == expected
    for parts in places.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_sum_of_squares_beats_next_fit_and_respects_capacity():
    sizes = np.random.default_rng(1).integers(1, 100, 2000)
    bins, offsets = packing.sum_of_squares(sizes, 100)
    filled = np.bincount(bins, sizes)
    next_fit, room = 0, 0
    for size in sizes.tolist():
        if size > room:
            next_fit, room = next_fit + 1, 100
        room -= size
    assert filled.max() <= 100 and len(filled) < 0.85 * next_fit
    assert all(sorted(offsets[bins == b])[0] == 0 for b in range(20))


def test_leaves_combine(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 90 + 1).alias("length"))
    out = packing.pack(rows, capacity=100, leaf_size=200).groupBy("sequence_id").agg(F.sum("length").alias("filled"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.filled == r.end <= 100 for r in out)
    assert len(out) <= 1.05 * sum(r.filled for r in out) / 100


def test_small_leaves_end_and_keep_every_piece(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 37 + 50).alias("length")).unionByName(spark.range(400, 440).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("length")))
    out = packing.pack(rows, capacity=100, leaf_size=7)
    assert out.count() == 440 and out.select("doc_id").distinct().count() == 440
    for r in out.groupBy("sequence_id").agg(F.sum("length").alias("filled"), F.max(F.col("offset") + F.col("length")).alias("end")).collect():
        assert r.filled == r.end <= 100


@pytest.mark.parametrize("operator", [exact_dedup.drop_exact_duplicates, ngram_join.drop_near_duplicates, mixing.mixed_documents, exact_dedup.exact_dedup, ngram_join.linked_documents, mixing.mix, lambda d: packing.packed_documents(d, packing.tokenizer_path())])
def test_empty_tables(documents, operator):
    assert operator(documents()).count() == 0


def test_pipeline_stages_keep_the_columns(spark, tmp_path, documents, words):
    rows = [(n, words(30 + n % 11) + (" idiot" if n % 10 == 0 else "")) for n in range(150)]
    documents(*rows, (200, rows[3][1]), (201, rows[4][1] + " end")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 1, int(n % 10 == 0)) for n in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    # Toxic rows, the copy and the near copy go; the mix has half as many words again.
    assert counts[:3] == [137, 136, 135]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]
