"""Re-parsed receipts against a model that runs the requests one after another."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from ticketlake.functions import warnings
from ticketlake.operators import reparse

RECEIPT = f"receipt_id bigint, store_id bigint, created_at timestamp_ntz, purchased_at timestamp_ntz, register_number string, ticket_number string, total_cents bigint, declared_article_count int, parser_status string, parser_warnings array<{warnings.WARNING_TYPE}>"
LINE = "line_id string, receipt_id bigint, position int, raw_text string, label string, label_truncated boolean, quantity decimal(10,3), unit_of_measure string, unit_price_cents bigint, vat_rate_bp int, tr_eligible boolean, kind string, total_cents bigint"
DAY = datetime(2024, 5, 5)


def line(name, receipt, total):
    return (name, receipt, 1, name, name, False, Decimal(1), "piece", total, 550, False, "item", total)


def strict(store, head):
    time, register, ticket, _ = head
    return (store, register, ticket, time) if store is not None and time and (register or "").strip() and (ticket or "").strip() else None


def daily(store, head):
    return (store, head[0].date(), head[3]) if store is not None and head[0] and head[3] is not None else None


def one_after_another(stored, wanted, barred):
    """Headers, refused ids and suspects when requests run in arrival order."""
    now, refused, suspects = {r: (store, head) for r, store, head in stored}, set(), {}
    for r, (head, failed) in sorted(wanted.items()):
        store, own = now[r]
        head = own if failed else head
        key = strict(store, head)
        clash = not failed and key is not None and any(strict(*now[o]) == key for o in now if o != r)
        if r in barred or clash:
            refused.add(r)
            continue
        day = daily(store, head)
        same = [(now[o][1][0], o) for o in now if o != r and day is not None and daily(*now[o]) == day]
        if same:
            suspects[r] = max(same)[1]
        now[r] = (store, head)
    return now, refused, suspects


def run(spark, stored, wanted, matched=(), unlinked=()):
    first = [(r, store, DAY + timedelta(seconds=r), *head, 1, "parsed", []) for r, store, head in stored]
    receipts = spark.createDataFrame(first, RECEIPT)
    lines = spark.createDataFrame([line(f"old-{r}", r, 1) for r, _, _ in stored], LINE)
    promotions = spark.createDataFrame([(r, f"old-{r}", "old") for r, _, _ in stored], "receipt_id bigint, linked_line_id string, label string")
    payments = spark.createDataFrame([(r, 1) for r, _, _ in stored], "receipt_id bigint, amount_cents bigint")
    fresh = spark.createDataFrame(
        [(r, *head, 1, "needs_review" if failed else "parsed", [], failed) for r, (head, failed) in wanted.items()],
        "receipt_id bigint, purchased_at timestamp_ntz, register_number string, ticket_number string, total_cents bigint, declared_article_count int, "
        f"parser_status string, parser_warnings array<{warnings.WARNING_TYPE}>, failed boolean",
    )
    again = {
        "receipts": fresh,
        "lines": spark.createDataFrame([line(f"new-{r}", r, head[3]) for r, (head, _) in wanted.items()], LINE),
        "promotions": spark.createDataFrame([(r, 9 if r in unlinked else 1, "new") for r in wanted], "receipt_id bigint, linked_line_position int, label string"),
        "payments": spark.createDataFrame([(r, (head[3] or 0) + (50 if r % 3 == 0 else 0)) for r, (head, _) in wanted.items()], "receipt_id bigint, amount_cents bigint"),
    }
    matches = spark.createDataFrame([(f"old-{r}",) for r in matched], "line_id string")
    tables = {"receipts": receipts, "lines": lines, "promotions": promotions, "payments": payments}
    return reparse.rerun_receipts(tables, matches, again)


def head(ticket, register="R", total=500, hour=0):
    return (DAY + timedelta(hours=hour), register, ticket, total)


def test_swapped_keys_chains_and_one_key_for_many(spark):
    stored = [(i, 1, head(f"t{i}")) for i in range(1, 13)]
    wanted = {1: (head("t2"), False), 2: (head("t1"), False), 4: (head("free"), False), 5: (head("t4"), False), 6: (head("t7"), False), 7: (head("more"), False)}
    wanted |= {i: (head("hot"), False) for i in (8, 9, 10)} | {11: (head("t11"), False), 12: (head("t3"), False)}
    out = run(spark, stored, wanted)
    # Swapped keys block each other; a key is free once its holder has moved before.
    assert {r.receipt_id for r in out["refused"].collect()} == {1, 2, 6, 9, 10, 12}
    tickets = {r.receipt_id: r.ticket_number for r in out["receipts"].collect()}
    assert tickets == {1: "t1", 2: "t2", 3: "t3", 4: "free", 5: "t4", 6: "t6", 7: "more", 8: "hot", 9: "t9", 10: "t10", 11: "t11", 12: "t12"}


def test_requests_equal_a_model_that_runs_them_in_turn(spark):
    chance = random.Random(11)
    stored, used = [], set()
    while len(stored) < 60:
        store, h = chance.choice([1, 2, None]), head(chance.choice([*"abcdefghijklmnop", "", None]), chance.choice("RS"), chance.choice([100, 200, None]), chance.choice([0, 1, 30]))
        key = strict(store, h)
        if key is None or key not in used:
            used.add(key)
            stored.append((len(stored), store, h))
    wanted = {}
    for r in chance.sample(range(60), 40):
        source = chance.choice([None, chance.choice(stored)[2]])
        wanted[r] = (source or head(chance.choice([*"abcdefghijklmnop", ""]), chance.choice("RS"), chance.choice([100, 200, None]), chance.choice([0, 1, 30])), chance.random() < 0.15)
    some = sorted(wanted)
    matched, unlinked = some[:3] + [next(r for r in range(60) if r not in wanted)], some[3:5]
    now, refused, suspects = one_after_another(stored, wanted, {*matched, *unlinked})
    out = run(spark, stored, wanted, matched, unlinked)
    reasons = {r.receipt_id: r.reason for r in out["refused"].collect()}
    assert set(reasons) == refused and {reasons[r] for r in some[:3]} == {"lines_already_matched"} and {reasons[r] for r in some[3:5]} == {"missing_promotion_line"}
    rows = {r.receipt_id: r for r in out["receipts"].collect()}
    assert {r: (w.store_id, (w.purchased_at, w.register_number, w.ticket_number, w.total_cents)) for r, w in rows.items()} == now
    done = set(wanted) - refused
    good = {r for r in done if not wanted[r][1]}
    for r, row in rows.items():
        codes = [w.code for w in row.parser_warnings]
        about = [w.detail for w in row.parser_warnings if w.code == "suspected_duplicate"]
        assert (str(suspects[r]) in about[0]) if r in suspects and r in done else not about
        bad_sum = r in good and r % 3 == 0 and row.total_cents is not None
        assert ("payments_sum_mismatch" in codes) == bad_sum
        if r in good and row.total_cents is not None:
            assert row.parser_status == ("needs_review" if codes else "parsed")
    assert suspects and good and refused
    for table, key in [("lines", "line_id"), ("promotions", "linked_line_id")]:
        expected = {f"old-{r}" for r in range(60) if r not in done} | {f"new-{r}" for r in good}
        assert sorted(v[key] for v in out[table].collect()) == sorted(expected)
    assert {r.receipt_id for r in out["payments"].collect()} == {r for r in range(60) if r not in done} | good


def test_no_requests_change_nothing(spark):
    stored = [(1, 1, head("a")), (2, None, (None, None, None, None))]
    out = run(spark, stored, {77: (head("z"), False)})
    assert out["refused"].count() == 0 and {r.receipt_id for r in out["receipts"].collect()} == {1, 2} and out["lines"].count() == 2
