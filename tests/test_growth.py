"""Plans that stay in proportion to their input, and tables stored as folders."""

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import classify, fuzzy
from ticketlake.operators import spread as spreading
from ticketlake.operators.spread import spread_join
from ticketlake.plans import QUERIES
from ticketlake.sources import locations


@pytest.mark.parametrize("folder", [False, True])
def test_streams_read_tables_stored_as_files_or_folders(spark, tmp_path, folder):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    parts = rows.repartition(3) if folder else rows.coalesce(1)
    parts.write.parquet(str(tmp_path / "written"))
    if folder:
        (tmp_path / "written").rename(tmp_path / "documents.parquet")
    else:
        next((tmp_path / "written").glob("part-*")).rename(tmp_path / "documents.parquet")
    # A table whose name begins alike is another table.
    rows.selectExpr("doc_id + 10 as doc_id", "text").write.parquet(str(tmp_path / "documents.parquet2"))
    assert sorted(r.document_id for r in QUERIES["stream_register"](spark, str(tmp_path)).collect()) == [1, 2]


def test_hot_keys_are_cut_into_cells_and_lose_nothing(spark):
    left = spark.createDataFrame([("hot", n) for n in range(40)] + [("hot", 7), ("cold", 1), (None, 2), ("left", 3)], "k string, a int")
    right = spark.createDataFrame([("hot", n) for n in range(30)] + [("cold", 5), ("cold", 5), (None, 2), ("right", 3)], "k string, b int")
    joined = spread_join(left, right, "k", cell_rows=100)
    assert sorted(joined.select("k", "a", "b").collect()) == sorted(left.join(right, "k").select("k", "a", "b").collect())
    tasks = joined.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1


def test_rows_copied_for_a_hot_key_follow_the_tasks_not_the_pairs(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = spark.range(3000).selectExpr("if(id < 2900, 'hot', 'cold') as k", "id as a")
    right = spark.range(2000).selectExpr("if(id < 1900, 'hot', 'cold') as k", "id as b")
    sides = spreading.spread(left, right, "k", cell_rows=100)
    cells = spreading.CELLS_PER_TASK * tasks
    assert sides[0].select("k", "_row", "_column").distinct().count() >= tasks
    # A copy of the right rows for each 100 pairs would be 2,900 times 1,900 rows.
    assert sum(side.count() for side in sides) < 5000 * 2 * cells**0.5
    joined = spread_join(left, right, "k", cell_rows=100)
    assert joined.count() == joined.distinct().count() == 2900 * 1900 + 100 * 100


def test_rejections_meet_lines_before_candidates_do(spark):
    lines = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "line_id string, normalized_label string")
    candidates = spark.createDataFrame([("x", 1), ("x", 2), ("x", None), ("y", 1)], "normalized_label string, variant_id bigint")
    matches = spark.createDataFrame([("a", 1, "rejected"), ("a", 1, "rejected"), ("a", 2, "ignored"), ("b", None, "rejected"), ("c", 1, "rejected")], "line_id string, variant_id bigint, status string")
    kept = fuzzy.exclude_rejected_pairs(lines, candidates, matches).select("line_id", "variant_id")
    found = sorted((r.line_id, r.variant_id or 0) for r in kept.collect())
    assert found == [("a", 0), ("a", 0), ("a", 2), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    # Pairs are made above the last exchange, so none is shuffled.
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: min(len(line) - len(line.lstrip(" :+-")) for line in plan if word in line)
    assert depth("Join Inner") < depth("Repartition") and "LeftAnti" not in "".join(plan)


def test_nested_leaves_come_from_one_chain(spark, tmp_path):
    texts = ['{"a":"x","b":{"c":["p",["q",{"d":"r"}],7,null],"e":{}},"f":null,"g":[]}', '"s"', "null", '["t"]', "[]", None]
    spark.createDataFrame(list(enumerate(texts)), "id int, hints string").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    flat = locations.flatten_identifiers(stored, ["id"], "hints", "h")
    assert sorted(tuple(r) for r in flat.collect()) == [
        (0, "h.a", "x"), (0, "h.b.c", "p"), (0, "h.b.c", "q"), (0, "h.b.c.d", "r"), (1, "h.", "s"), (3, "h.", "t"),
    ]
    assert flat._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    leaves = {(r.id, ".".join(r.path), r.kind, r.json) for r in locations._leaves(stored, ["id"], "hints").collect()}
    assert (0, "g", "ARRAY", "[]") in leaves and (2, "", "VOID", "null") in leaves and len(leaves) == 8


def test_stores_are_chosen_once_for_documents_that_name_the_same(spark):
    hits = [(d, h) for d in range(6) for h in (["alias"] if d < 4 else ["place", "alias"])]
    hits = spark.createDataFrame(hits + [(9, "alias"), (None, "alias")], "document_id bigint, normalized_value string")
    formats = [(d, "u.paper.v1") for d in range(6)] + [(8, "u.paper.v1"), (None, None), (3, "leclerc.web.v1"), (3, "leclerc.web.v1"), (2, None)]
    formats = spark.createDataFrame(formats, "document_id bigint, parser_format string")
    stores = [(n, ["physical", "drive"][n % 2], "alias", False) for n in range(4)] + [(2, "physical", "place", True)]
    hints = spark.createDataFrame(stores, "store_id bigint, channel string, normalized_value string, specific boolean").selectExpr(
        "*", "'s' as source", "normalized_value as value", "named_struct('_rank', 0, '_at', 0, 'source', 's', 'value', normalized_value) as position")
    defaults = spark.createDataFrame([(0, "u.paper.v1"), (1, "other"), (0, "u.paper.v1")], "store_id bigint, default_parser_format string")
    documents, *signed = classify.shared_signatures(formats, hits)
    assert documents.select("signature").distinct().count() == 4 and documents.count() == 6
    shown = ["document_id", "detected_store", "store_confidence", "detected_stores"]
    once = classify.choose_store(classify.store_evidence(*signed, hints, defaults)).withColumnRenamed("document_id", "signature")
    each = classify.store_evidence(formats, hits, hints, defaults)
    found = documents.join(once, "signature").select(*shown).collect()
    assert sorted(found) == sorted(classify.choose_store(each).select(*shown).collect())
    lists = {r.document_id: ",".join(r.detected_stores) for r in found}
    assert lists == {0: "0,2", 1: "0,2", 2: "0,1,2,3", 3: "0,1,2,3", 4: "2", 5: "2"}
    # Both default rows of store 0, once for each document it is in scope of.
    assert each.where("entry.code = 'store_default_parser_format'").count() == 2 * 6
