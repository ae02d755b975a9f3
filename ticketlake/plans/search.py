"""Catalogue search and suggestion queries."""

from pyspark.sql import functions as F

from ticketlake.functions import trigram
from ticketlake.operators import fuzzy as ops
from ticketlake.operators import matching
from ticketlake.operators.spread import spread_join
from ticketlake.plans.backlog import eligible
from ticketlake.plans.registry import query

MISSPELT = "replace(replace(p_name, 'e', 'a'), 'll', 'l')"


def names(t):
    return t.table("part").selectExpr("p_name as name").distinct()


def misspelt(t):
    return t.table("part").selectExpr(f"{MISSPELT} as query").distinct()


def labels(t):
    return t.table("part").selectExpr("p_name as query").distinct()


def search(t, limit):
    return ops.catalogue_search(labels(t), t.product_brands, t.products, t.variants, limit)


def _scored(t):
    """Score columns for (label, misspelt label) of every part: no pairing needed."""
    return t.table("part").selectExpr("p_partkey", "p_name as name", f"{MISSPELT} as query")


SCORED = f"SELECT p_partkey, {{0}} FROM part JOIN scores_v s ON s.query = {MISSPELT} AND s.name = p_name"


@query("trigram_similarity", SCORED.format("round(similarity, 6) AS score"))
def trigram_similarity(t):
    return _scored(t).select("p_partkey", F.round(trigram.trigram_similarity(F.col("query"), F.col("name")), 6).alias("score"))


@query("word_similarity", SCORED.format("round(forward, 6) AS forward, round(backward, 6) AS backward"))
def word_similarity(t):
    return _scored(t).select(
        "p_partkey",
        F.round(trigram.word_similarity(F.col("query"), F.col("name")), 6).alias("forward"),
        F.round(trigram.word_similarity(F.col("name"), F.col("query")), 6).alias("backward"),
    )


@query("search_score", SCORED.format("round(score * 100, 2) AS score, CAST(least(greatest(CAST(round(score * 100, 2) AS DECIMAL(9,4)) / 100, 0), 1) AS DECIMAL(5,4)) AS confidence"))
def search_score(t):
    best = trigram.best_score(trigram.ordered_trigrams(F.col("query")), trigram.ordered_trigrams(F.col("name")))
    scored = _scored(t).select("p_partkey", trigram.search_score(best).alias("score"))
    return scored.withColumn("confidence", trigram.score_confidence(F.col("score")))


@query("fuzzy_label_join", f"""SELECT query, name, round(score, 6) AS score FROM scores_v
    WHERE score >= 0.18 AND query IN (SELECT {MISSPELT} FROM part) AND name IN (SELECT p_name FROM part)""")
def fuzzy_label_join(t):
    return ops.fuzzy_label_join(misspelt(t), "query", names(t), "name").withColumn("score", F.round("score", 6))


@query("best_attribute_score", """SELECT query, record_id, round(max(score) * 100, 2) AS score, arg_max(matched_attribute, (score, -place)) AS matched_attribute
    FROM attribute_hits_v WHERE record_type = 'product_variant' AND query IN (SELECT p_name FROM part) GROUP BY ALL""")
def best_attribute_score(t):
    texts = names(t).unionByName(t.products.selectExpr("normalized_name as name")).unionByName(t.product_brands.selectExpr("normalized_name as name"))
    scored = ops.fuzzy_label_join(labels(t), "query", texts.distinct(), "name")
    attributes = F.array(
        *[
            F.struct(F.col(column).alias("name"), F.lit(attribute).alias("matched_attribute"), F.lit(rank).alias("_attribute_rank"))
            for rank, (column, attribute) in enumerate(
                [("normalized_name", "normalized_name"), ("product_normalized_name", "product_name"), ("brand_normalized_name", "product_brand_name")]
            )
        ]
    )
    hits = spread_join(t.variants.select(F.col("record_id").cast("string").alias("record_id"), F.inline(attributes)), scored, "name")
    return ops.best_attribute_score(hits, ["query", "record_id"]).withColumn("score", trigram.search_score(F.col("score")))


HIT = "query, record_type, record_id, name, matched_attribute, score, rank"


@query("catalogue_search", f"SELECT {HIT} FROM ranked_hits_v WHERE rank <= 100")
def catalogue_search(t):
    return search(t, 1000).selectExpr(*HIT.replace("rank", "cast(rank as bigint) as rank").split(", "))


@query("search_rank_limit", f"SELECT {HIT} FROM ranked_hits_v WHERE rank <= 20")
def search_rank_limit(t):
    return search(t, 20).selectExpr(*HIT.replace("rank", "cast(rank as bigint) as rank").split(", "))


@query("search_variants_only", "SELECT query, record_id, score FROM ranked_hits_v WHERE rank <= 20 AND record_type = 'product_variant'")
def search_variants_only(t):
    return ops.variants_only(search(t, 20)).select("query", "record_id", "score")


@query("expand_hits_to_variants", "SELECT query, record_type, record_id, variant_id FROM expanded_v")
def expand_hits_to_variants(t):
    return ops.expand_hits_to_variants(search(t, 20), t.variants).select("query", "record_type", "record_id", "variant_id")


@query("prior_confirmed_by_label", "SELECT normalized_label, variant_id, decided_at FROM prior_v")
def prior_confirmed_by_label(t):
    return ops.prior_confirmed_by_label(t.matches)


@query("exclude_rejected_pairs", """SELECT l.line_id, p.variant_id FROM lines_v l JOIN prior_v p ON p.normalized_label = l.p_name
    LEFT JOIN matches_v m ON m.line_id = l.line_id AND m.variant_id = p.variant_id AND m.status = 'rejected'
    WHERE m.line_id IS NULL AND l.kind = 'item'""")
def exclude_rejected_pairs(t):
    """Every item line, whatever was decided about it. Only items are ever matched (`suggestible_receipt_line?`)."""
    prior = ops.prior_confirmed_by_label(t.matches)
    items = t.lines.where("kind = 'item'").select("line_id", F.col("p_name").alias("normalized_label"))
    return ops.exclude_rejected_pairs(items, prior, t.matches).select("line_id", "variant_id")


@query("first_suggestion_per_variant", """SELECT normalized_label, variant_id, reason, confidence FROM candidates_v
    QUALIFY row_number() OVER (PARTITION BY normalized_label, variant_id ORDER BY source, hit, recency, variant_name) = 1""")
def first_suggestion_per_variant(t):
    expanded = ops.expand_hits_to_variants(search(t, 20), t.variants)
    merged = ops._candidates(ops.prior_confirmed_by_label(t.matches), expanded)
    return ops.first_suggestion_per_variant(merged, ["normalized_label"]).drop("_order")


def suggestions(t, limit=5):
    return ops.suggest_matches(eligible(t), t.matches, t.product_brands, t.products, t.variants, limit)


@query("suggestion_candidates", "SELECT line_id, variant_id, reason, confidence FROM suggestions_v")
def suggestion_candidates(t):
    return suggestions(t).select("line_id", "variant_id", "reason", "confidence")


@query("top_k_suggestions", "SELECT line_id, variant_id, rank FROM suggestions_v")
def top_k_suggestions(t):
    return suggestions(t).select("line_id", "variant_id", F.col("rank").cast("bigint").alias("rank"))


@query("receipt_queue", """SELECT e.receipt_id, e.position, s.line_id, s.variant_id, s.rank FROM suggestions_v s JOIN eligible_v e USING (line_id)
    WHERE e.receipt_id IN (SELECT receipt_id FROM receipts_v WHERE store_id = 3)""")
def receipt_queue(t):
    lines = matching.receipt_unmatched_lines(t.lines, t.receipts, t.matches, t.receipts.where("store_id = 3"))
    found = ops.suggest_matches(lines, t.matches, t.product_brands, t.products, t.variants)
    return lines.select("line_id", "receipt_id", "position").join(found, "line_id").select(
        "receipt_id", "position", "line_id", "variant_id", F.col("rank").cast("bigint").alias("rank")
    )
