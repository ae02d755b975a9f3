"""Behaviour on small fixtures: brute force, folding goldens, skew-safe helpers, streaming."""

import itertools

from pyspark.sql import functions as F

from ticketlake.functions import money, text, trigram
from ticketlake.operators import classify, decisions, fuzzy, matching
from ticketlake.operators.ordering import running_max_before, with_rank
from ticketlake.streaming import jobs

NAMES = ["lait demi ecreme", "lait entier", "beurre doux", "beurre demi sel", "pate a tartiner", "the vert", "cafe moulu", "x"]


def py_trigrams(value):
    return [f"  {w} "[i:i + 3] for w in value.split() for i in range(len(w) + 1)]


def py_overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def py_score(a, b):
    ta, tb = py_trigrams(a), py_trigrams(b)

    def extent(wanted, ordered):
        spans = itertools.combinations(range(len(ordered) + 1), 2)
        return max((py_overlap(set(wanted), set(ordered[i:j])) for i, j in spans), default=0.0)

    return max(py_overlap(set(ta), set(tb)), extent(ta, tb), extent(tb, ta))


def test_fuzzy_join_equals_brute_force(spark):
    labels = ["lait", "beure doux", "tartine", "cafe", "inconnu", "lait x"]
    left = spark.createDataFrame([(x,) for x in labels], "query string")
    right = spark.createDataFrame([(x,) for x in NAMES], "name string")
    for cell in (20_000, 2):
        fuzzy.POSTING_CELL, kept = cell, fuzzy.POSTING_CELL
        try:
            rows = fuzzy.fuzzy_label_join(left, "query", right, "name").collect()
        finally:
            fuzzy.POSTING_CELL = kept
        found = {(r["query"], r["name"]): round(r["score"], 9) for r in rows}
        scores = {(a, b): round(py_score(a, b), 9) for a in labels for b in NAMES}
        assert found == {pair: s for pair, s in scores.items() if s >= 0.18}


def test_fuzzy_join_has_no_cartesian_product(spark):
    left = spark.createDataFrame([("lait",)], "query string")
    right = spark.createDataFrame([("lait entier",)], "name string")
    plan = fuzzy.fuzzy_label_join(left, "query", right, "name")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_documented_word_similarity(spark):
    row = spark.range(1).select(
        trigram.trigram_similarity(F.lit("word"), F.lit("two words")).alias("s"), trigram.word_similarity(F.lit("word"), F.lit("two words")).alias("w")
    ).first()
    assert (round(row.s, 4), round(row.w, 4)) == (0.3636, 0.8)


def test_folding_goldens(spark):
    cases = {
        "Crème Brûlée": ("creme brulee", "creme brulee"),
        "ŒUF  cœur": ("oeuf coeur", "uf c ur"),
        "Straße": ("strasse", "stra e"),
        "ﬁne ² ①": ("fine 2 1", "ne"),
        "été": ("ete", "ete"),
        "５％ ½": ("5 1 2", ""),
        "日本": ("", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = df.select("t", text.normalize_text(F.col("t")).alias("a"), text.normalize_detection_text(F.col("t")).alias("b")).collect()
    assert {r.t: (r.a, r.b) for r in rows} == cases


def test_amounts_keep_their_sign(spark):
    df = spark.createDataFrame([("-0,50",), ("12.05",), ("3",), (None,), ("-7,1",)], "x string")
    assert [r.c for r in df.select(money.cents_from(F.col("x")).alias("c")).collect()] == [-50, 1205, 300, None, -701]


def test_rank_and_running_maximum_on_one_hot_key(spark):
    df = spark.range(500).selectExpr("id", "'hot' as k", "(id * 37) % 500 as at", "(id * 91) % 500 as v")
    ranked = {r.id: r.rank for r in with_rank(df, [F.col("at").asc()]).collect()}
    assert ranked == {r.id: r["at"] + 1 for r in df.collect()}
    out = {r["at"]: (r.v, r.m) for r in running_max_before(df, ["k"], ["at"], F.col("v"), "m").collect()}
    best = None
    for at in range(500):
        value, running = out[at]
        assert running == best
        best = value if best is None else max(best, value)


def test_label_groups_merge_spellings(spark):
    rows = [("Crème", 1, 130), ("CREME", 2, 240), ("CREME", 3, 130)]
    lines = spark.createDataFrame(rows, "label string, receipt_id int, total_cents int").withColumns(
        {"purchased_at": F.lit("2024-01-01").cast("timestamp_ntz"), "normalized_label": text.normalize_text(F.col("label"))}
    )
    group = matching.label_groups(lines).collect()
    assert [(g.normalized_label, g.representative_label, g.line_count) for g in group] == [("creme", "CREME", 3)]


def test_store_hints_match_whole_words_only(spark):
    docs = spark.createDataFrame([("a", "magasin de Villeneuve sur Lot"), ("b", "villeneuves")], "document_id string, text string")
    hints = spark.createDataFrame([("villeneuve",), ("villeneuve sur lot",)], "normalized_value string")
    hits = {(r.document_id, r.normalized_value) for r in classify.hint_hits(docs, hints).collect()}
    assert hits == {("a", "villeneuve"), ("a", "villeneuve sur lot")}


def test_decision_stream_in_many_batches_equals_batch(spark, tmp_path):
    log = spark.range(200).selectExpr(
        "id % 9 as line_id", "(id * 7) % 3 as variant_id", "element_at(array('confirm', 'ignore', 'reject', 'suggest'), cast((id * 5) % 4 + 1 as int)) as action",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as decided_at", "id as seq",
    )
    for part in range(4):
        log.where(f"seq div 50 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_available(stream, jobs.decisions_job(f"{tmp_path}/log"), str(tmp_path))
    expected = {tuple(r) for r in decisions.current_decisions(log).collect()}
    assert {tuple(r) for r in jobs.current_decisions(spark, f"{tmp_path}/log").collect()} == expected
