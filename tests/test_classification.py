"""Every branch of the status classifier and the P/L rule on small frames."""

import datetime as dt
from decimal import Decimal

from settlekit import schema as S
from settlekit.operators.analyze import analyze

RUN = dt.datetime(2025, 3, 31)
D = Decimal


def _frames(spark, orders, returns, settlements, prev=None):
    o = spark.createDataFrame(orders, "order_release_id string, order_line_id string, order_status string, "
                                      "is_ship_rel long, created_on timestamp, final_amount decimal(18,4), "
                                      "brand string")
    r = spark.createDataFrame(returns, "order_release_id string, return_type string, "
                                       "total_actual_settlement decimal(18,4), _ord long")
    s = spark.createDataFrame(settlements, "order_release_id string, total_actual_settlement decimal(18,4), "
                                           "total_commission decimal(18,4), _ord long")
    p = None
    if prev is not None:
        p = spark.createDataFrame(prev, "order_release_id string, order_line_id string, status string")
    return analyze(o, r, s, p, RUN)


def test_every_status_branch(spark):
    t = dt.datetime(2025, 1, 15)
    orders = [
        ("a", "1", "C", 0, t, D(100), "X"),       # cancelled before shipment
        ("b", "1", "C", 1, t, D(100), "X"),       # cancelled after shipment
        ("c", "1", "D", 1, t, D(100), "X"),       # refund
        ("d", "1", "D", 1, t, D(100), "X"),       # exchange
        ("e", "1", "D", 1, t, D(100), "X"),       # other return type, settled
        ("f", "1", "D", 1, t, D(100), "X"),       # settled
        ("g", "1", "D", 1, t, D(100), "X"),       # pending
        ("h", "1", "RTO", 1, t, D(100), "X"),     # RTO
        ("i", "1", "P", 1, t, D(100), "X"),       # unknown
        ("j", "1", "C", None, t, D(100), "X"),    # missing ship flag -> unknown
    ]
    returns = [("c", "return_refund", D(30), 1), ("c", "exchange", D(99), 2),
               ("d", "exchange", D(20), 1), ("e", "damaged", D(5), 1), ("h", "return_refund", D(7), 1)]
    settlements = [("e", D(80), D(3), 1), ("f", D(90), D(4), 2), ("f", D(1), D(1), 1), ("b", D(10), D(1), 1)]
    got = {r.order_release_id: r for r in _frames(spark, orders, returns, settlements).collect()}
    assert got["a"].status == S.CANCELLED_NO_IMPACT and got["a"].profit_loss == 0
    assert got["b"].status == S.CANCELLED_AFTER_SHIPMENT and got["b"].profit_loss == D(10)
    assert got["c"].status == S.RETURNED_REFUNDED and got["c"].profit_loss == D(-30)   # first return only
    assert got["d"].status == S.RETURNED_EXCHANGED
    assert got["e"].status == S.DELIVERED_SETTLED and got["e"].profit_loss == D(75)   # falls through
    assert got["f"].status == S.DELIVERED_SETTLED and got["f"].order_settlement == D(1)  # first by order
    assert got["g"].status == S.DELIVERED_PENDING and got["g"].profit_loss == 0
    assert got["h"].status == S.RTO_RETURNED and got["h"].profit_loss == D(-7)
    assert got["i"].status == S.UNKNOWN_STATUS
    assert got["j"].status == S.UNKNOWN_STATUS
    assert got["g"].net_revenue is None and got["f"].commission_cost == D(1)
    assert got["c"].status_group == S.GROUP_RETURNED and got["h"].status_group == S.GROUP_RETURNED


def test_status_change_against_previous_run(spark):
    t = dt.datetime(2025, 1, 15)
    orders = [("a", "1", "D", 1, t, D(1), "X"), ("b", "1", "D", 1, t, D(1), "X"), ("c", "1", "D", 1, t, D(1), "X")]
    settlements = [("a", D(5), D(0), 1)]
    prev = [("a", "1", S.DELIVERED_PENDING), ("b", "1", S.DELIVERED_PENDING),
            ("b", "2", S.DELIVERED_SETTLED)]          # duplicates: the last row wins
    got = {r.order_release_id: r for r in _frames(spark, orders, [], settlements, prev).collect()}
    assert got["a"].status_changed_this_run and got["a"].settlement_update_run_timestamp == RUN
    assert got["b"].previous_status == S.DELIVERED_SETTLED and got["b"].status_changed_this_run
    assert not got["c"].status_changed_this_run and got["c"].settlement_update_run_timestamp is None


def test_empty_orders_give_empty_analysis(spark):
    assert _frames(spark, [], [], []).count() == 0


def test_without_row_order_the_master_file_order_decides(spark):
    """Masters are written newest upload first: the first return of an order
    is the newest one; in the previous analysis the last row (oldest) wins."""
    t1, t2 = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    o = spark.createDataFrame([("a", "1", "D", 1, t1, D(1), "X")],
                              "order_release_id string, order_line_id string, order_status string, "
                              "is_ship_rel long, created_on timestamp, final_amount decimal(18,4), brand string")
    r = spark.createDataFrame([("a", "1", "return_refund", D(5), t1), ("a", "2", "exchange", D(7), t2),
                               ("a", "3", "return_refund", D(9), None)],
                              "order_release_id string, order_line_id string, return_type string, "
                              "total_actual_settlement decimal(18,4), upload_timestamp timestamp")
    s = spark.createDataFrame([], "order_release_id string, total_actual_settlement decimal(18,4)")
    prev = spark.createDataFrame([("a", "1", S.DELIVERED_SETTLED, t2), ("a", "2", S.DELIVERED_PENDING, t1)],
                                 "order_release_id string, order_line_id string, status string, "
                                 "upload_timestamp timestamp")
    row = analyze(o, r, s, prev, RUN, order_col=None).first()
    assert row.status == S.RETURNED_EXCHANGED and row.return_settlement == D(7)
    assert row.previous_status == S.DELIVERED_PENDING
