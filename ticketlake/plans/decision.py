"""Decision, price and bulk-action queries."""

from pyspark.sql import functions as F

from ticketlake.operators import decisions as ops
from ticketlake.operators.ordering import with_rank
from ticketlake.plans.backlog import eligible
from ticketlake.plans.registry import query
from ticketlake.plans.search import suggestions

REQUESTS = "SELECT line_id, part_id % 7 AS variant_id, shipped_at AS decided_at, label, receipt_id FROM lines_v WHERE kind = 'item' AND tax_step IN (2, 5, 6, 7, 8)"
ALLOWED = f"SELECT q.* FROM ({REQUESTS}) q JOIN receipts_v r USING (receipt_id) WHERE parser_status = 'reviewed' AND purchased_at IS NOT NULL"


def requests(t):
    return t.lines.where("kind = 'item' and tax_step in (2, 5, 6, 7, 8)").selectExpr("line_id", "part_id % 7 as variant_id", "shipped_at as decided_at")


def shown(df):
    return df.select("line_id", "variant_id", "status", "source", "confidence", "normalized_label_snapshot", "decided_at")


def _applied(status, chosen, requests_sql, variant="q.variant_id"):
    """Rewritten rows beside untouched ones; every line has at most one match row in the data."""
    return f"""SELECT q.line_id, {variant} AS variant_id, '{status}' AS status, 'user' AS source, CAST(NULL AS DECIMAL(5,4)) AS confidence,
        l.p_name AS normalized_label_snapshot, q.decided_at FROM ({requests_sql}) q JOIN lines_v l USING (line_id)
        UNION ALL SELECT m.line_id, m.variant_id, m.status, m.source, m.confidence, m.normalized_label_snapshot, m.decided_at FROM matches_v m
        LEFT JOIN ({requests_sql}) q USING (line_id) WHERE q.line_id IS NULL OR NOT ({chosen})"""


@query("apply_confirmations", _applied("confirmed", "m.status IN ('confirmed', 'ignored') OR (m.status = 'suggested' AND m.variant_id = q.variant_id)", ALLOWED))
def apply_confirmations(t):
    return shown(ops.apply_confirmations(requests(t), t.matches, t.lines, t.receipts)[0])


@query("refused_confirmations", f"""SELECT line_id, CASE WHEN parser_status <> 'reviewed' THEN 'receipt_not_reviewed' ELSE 'purchase_date_missing' END AS reason
    FROM ({REQUESTS}) JOIN receipts_v USING (receipt_id) WHERE parser_status <> 'reviewed' OR purchased_at IS NULL""")
def refused_confirmations(t):
    return ops.apply_confirmations(requests(t), t.matches, t.lines, t.receipts)[1].select("line_id", "reason")


@query("apply_ignores", _applied("ignored", "m.status IN ('confirmed', 'ignored')", REQUESTS, "CAST(NULL AS BIGINT)"))
def apply_ignores(t):
    observations = t.matches.where("status = 'confirmed'").select("match_id", "line_id")
    return shown(ops.apply_ignores(requests(t), t.matches, t.lines, observations)[0])


@query("observations_after_ignores", f"SELECT line_id FROM matches_v WHERE status = 'confirmed' AND line_id NOT IN (SELECT line_id FROM ({REQUESTS}))")
def observations_after_ignores(t):
    observations = t.matches.where("status = 'confirmed'").select("match_id", "line_id")
    return ops.apply_ignores(requests(t), t.matches, t.lines, observations)[1].select("line_id")


@query("apply_rejections", _applied("rejected", "m.status IN ('suggested', 'rejected') AND m.variant_id = q.variant_id", REQUESTS))
def apply_rejections(t):
    return shown(ops.apply_rejections(requests(t), t.matches, t.lines))


@query("persist_suggestions", """WITH stored AS (SELECT line_id, variant_id, decided_at FROM matches_v WHERE status = 'suggested')
    SELECT s.line_id, s.variant_id, 'suggested' AS status, 'heuristic' AS source, s.confidence, l.p_name AS normalized_label_snapshot, o.decided_at
    FROM suggestions_v s JOIN lines_v l USING (line_id) LEFT JOIN stored o ON o.line_id = s.line_id AND o.variant_id = s.variant_id
    UNION ALL SELECT m.line_id, m.variant_id, m.status, m.source, m.confidence, m.normalized_label_snapshot, m.decided_at FROM matches_v m
    LEFT JOIN suggestions_v s ON m.status = 'suggested' AND m.line_id = s.line_id AND m.variant_id = s.variant_id WHERE s.line_id IS NULL""")
def persist_suggestions(t):
    return shown(ops.persist_suggestions(suggestions(t), t.matches, t.lines))


LOG = """SELECT user_id AS line_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS variant_id,
    CASE event_type WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'ignore' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'suggest' END AS action,
    ts AS decided_at, event_id AS seq FROM events WHERE event_type <> 'purchase'"""


def decision_log(t):
    return t.table("events").where("event_type <> 'purchase'").selectExpr(
        "user_id as line_id",
        "cast(get_json_object(props, '$.k') as bigint) % 4 as variant_id",
        "case event_type when 'click' then 'confirm' when 'view' then 'ignore' when 'error' then 'reject' when 'signup' then 'suggest' end as action",
        "cast(ts as timestamp_ntz) as decided_at",
        "event_id as seq",
    )


CURRENT = f"""WITH log AS ({LOG}), terminal AS (SELECT line_id, arg_max(variant_id, (decided_at, seq)) AS v, arg_max(action, (decided_at, seq)) AS a, max(decided_at) AS d,
    arg_min(variant_id, (decided_at, seq)) AS fv, arg_min(action, (decided_at, seq)) AS fa, min(seq) AS fs FROM log WHERE action IN ('confirm', 'ignore') GROUP BY 1),
    pairs AS (SELECT line_id, variant_id, max(CASE WHEN action = 'reject' THEN seq END) AS r, max(CASE WHEN action = 'reject' THEN decided_at END) AS rd,
    max(CASE WHEN action = 'suggest' THEN seq END) AS s, max(CASE WHEN action = 'suggest' THEN decided_at END) AS sd FROM log GROUP BY 1, 2)
    SELECT line_id, CASE a WHEN 'confirm' THEN v END AS variant_id, CASE a WHEN 'confirm' THEN 'confirmed' ELSE 'ignored' END AS status, d AS decided_at FROM terminal
    UNION ALL SELECT line_id, variant_id, 'rejected', rd FROM pairs WHERE r IS NOT NULL
    UNION ALL SELECT p.line_id, p.variant_id, 'suggested', sd FROM pairs p LEFT JOIN terminal t ON t.line_id = p.line_id AND fa = 'confirm' AND fv = p.variant_id
    WHERE s IS NOT NULL AND (r IS NULL OR s > r) AND (fs IS NULL OR s > fs)"""


@query("current_decisions", CURRENT)
def current_decisions(t):
    return ops.current_decisions(decision_log(t))


# Groups whose label starts after "n" were previewed before one of their lines was decided.
EXPECTED = """SELECT 'r-' || normalized_label AS request_id, normalized_label, line_id FROM eligible_v
    UNION ALL SELECT 'r-' || normalized_label, normalized_label, 'gone-' || normalized_label FROM groups_v WHERE normalized_label > 'n'"""


def expected(t):
    lines = eligible(t)
    asked = lines.selectExpr("concat('r-', normalized_label) as request_id", "normalized_label", "line_id")
    stale = lines.where("normalized_label > 'n'").select("normalized_label").distinct().selectExpr(
        "concat('r-', normalized_label) as request_id", "normalized_label", "concat('gone-', normalized_label) as line_id"
    )
    return asked.unionByName(stale), lines


@query("stale_set_guard", """SELECT 'r-' || normalized_label AS request_id, line_count + CASE WHEN normalized_label > 'n' THEN 1 ELSE 0 END AS expected_count,
    line_count AS current_count, normalized_label <= 'n' AS accepted FROM groups_v""")
def stale_set_guard(t):
    return ops.stale_set_guard(*expected(t)).select("request_id", "expected_count", "current_count", "accepted")


@query("bulk_confirm", """SELECT e.line_id, CAST(length(normalized_label) AS BIGINT) AS variant_id FROM eligible_v e WHERE normalized_label <= 'n'""")
def bulk_confirm(t):
    lines = ops.bulk_decision_lines(*expected(t)).select(
        "line_id", F.length("normalized_label").cast("bigint").alias("variant_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("decided_at")
    )
    state, _ = ops.apply_confirmations(lines, t.matches, t.lines, t.receipts)
    return state.where("status = 'confirmed' and decided_at = timestamp_ntz'2024-01-01 00:00:00'").select("line_id", "variant_id")


@query("bulk_ignore", "SELECT line_id FROM eligible_v WHERE normalized_label <= 'n'")
def bulk_ignore(t):
    lines = ops.bulk_decision_lines(*expected(t)).select("line_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("decided_at"))
    state, _ = ops.apply_ignores(lines, t.matches, t.lines, t.matches.select("line_id"))
    return state.where("status = 'ignored' and decided_at = timestamp_ntz'2024-01-01 00:00:00'").select("line_id")


@query("bulk_preview", "SELECT normalized_label, min(label) AS representative_label, count(*) AS affected_count FROM eligible_v GROUP BY 1")
def bulk_preview(t):
    return ops.bulk_preview(eligible(t))


OBSERVED = """SELECT 'm-' || line_id AS match_id, line_id, part_id AS variant_id, store_id, purchased_at AS observed_at, quantity AS purchased_quantity, total_cents,
    CAST(round(CAST(total_cents AS DECIMAL(18,0)) / quantity) AS BIGINT) AS pack_unit_price_cents, CASE WHEN quantity_value IS NOT NULL THEN comparison_unit_id END AS comparison_unit_id,
    CASE WHEN comparison_unit_id IS NOT NULL AND quantity_value IS NOT NULL THEN
    CAST(floor(CAST(total_cents AS HUGEINT) * 2 * 1000000 / (2 * CAST(quantity * 1000 AS HUGEINT) * coalesce(package_count, 1) * CAST(quantity_value * 1000 AS HUGEINT)) + 0.5) AS BIGINT) END AS comparison_unit_price_cents
    FROM (SELECT l.*, r.store_id, r.purchased_at FROM lines_v l JOIN receipts_v r USING (receipt_id)) JOIN variants_v ON part_id = record_id WHERE tax_step = 5 AND purchased_at IS NOT NULL"""


def observations(t):
    return ops.price_observations(t.matches, t.lines, t.receipts, t.variants)


@query("price_observations", OBSERVED)
def price_observations(t):
    return observations(t).drop("source", "purchased_unit")


def _history(name, where, **scope):
    @query(name, f"SELECT line_id, row_number() OVER (ORDER BY observed_at DESC, line_id DESC) AS rank FROM ({OBSERVED}) WHERE {where}")
    def history(t):
        return with_rank(ops.price_history(observations(t), **scope), ops.history_order()).select("line_id", "rank")


_history("price_history", "variant_id = 42", variant_id=42)
_history("price_history_by_store", "store_id = 3", store_id=3)
_history("price_history_by_variant_and_store", "variant_id = 7 AND store_id = 3", variant_id=7, store_id=3)
_history("price_history_by_day", "observed_at >= TIMESTAMP '1998-10-03' AND observed_at < TIMESTAMP '1998-10-04'", day="1998-10-03")
