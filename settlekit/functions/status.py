"""Row classification expressions (native Catalyst expressions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from settlekit import schema as S


def order_status(order_status: Column, is_ship_rel: Column, has_return: Column,
                 return_type: Column, has_settlement: Column) -> Column:
    """Settlement status of one order; the tests are evaluated in this order.

    A delivered order whose first return has a type other than refund /
    exchange falls through to the settlement test.
    """
    delivered = order_status == F.lit("D")
    return (F.when((is_ship_rel == 0) & (order_status == "C"), F.lit(S.CANCELLED_NO_IMPACT))
            .when((is_ship_rel == 1) & (order_status == "C"), F.lit(S.CANCELLED_AFTER_SHIPMENT))
            .when(delivered & has_return & (return_type == S.RETURN_REFUND), F.lit(S.RETURNED_REFUNDED))
            .when(delivered & has_return & (return_type == S.RETURN_EXCHANGE), F.lit(S.RETURNED_EXCHANGED))
            .when(delivered & has_settlement, F.lit(S.DELIVERED_SETTLED))
            .when(delivered, F.lit(S.DELIVERED_PENDING))
            .when(order_status == "RTO", F.lit(S.RTO_RETURNED))
            .otherwise(F.lit(S.UNKNOWN_STATUS)))


def profit_loss(order_status: Column, is_ship_rel: Column, settlement_amount: Column,
                return_amount: Column) -> Column:
    """First settlement minus first return (each 0 when absent); 0 when
    cancelled before shipment. Amounts are already 0 for absent records."""
    return (F.when((is_ship_rel == 0) & (order_status == "C"), F.lit(0))
            .otherwise(settlement_amount - return_amount))


def status_group(status: Column) -> Column:
    """Roll the eight statuses up to the report vocabulary."""
    return (F.when(status.startswith("Cancelled"), F.lit(S.GROUP_CANCELLED))
            .when(status.contains("Returned"), F.lit(S.GROUP_RETURNED))
            .when(status == S.DELIVERED_SETTLED, F.lit(S.GROUP_SETTLED))
            .when(status == S.DELIVERED_PENDING, F.lit(S.GROUP_PENDING))
            .otherwise(F.lit(S.GROUP_UNKNOWN)))


def status_label(raw_status: Column) -> Column:
    """Raw order_status code -> text label (NULL for unknown codes)."""
    codes = list(S.STATUS_LABELS.items())
    out = F.when(raw_status == codes[0][0], F.lit(codes[0][1]))
    for code, label in codes[1:]:
        out = out.when(raw_status == code, F.lit(label))
    return out


def payment_status(expected: Column, actual: Column) -> Column:
    """Paid when actual covers expected, Partial when something arrived."""
    return (F.when(actual >= expected, F.lit("Paid"))
            .when(actual > 0, F.lit("Partial"))
            .otherwise(F.lit("Pending")))


def is_returned(status: Column) -> Column:
    """Returned family (substring test, so it includes ``RTO - Returned``)."""
    return F.coalesce(status.contains("Returned"), F.lit(False))


def is_settled_family(status: Column) -> Column:
    return F.coalesce(status.contains("Settled"), F.lit(False))
