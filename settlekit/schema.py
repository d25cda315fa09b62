"""Column specifications of the three extracts and the status vocabulary.

One ``ColumnSpec`` list per entity is the single source for renaming,
projection, coercion and the required-null checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DATE, STRING, INTEGER, FLOAT, BOOLEAN = "date", "string", "integer", "float", "boolean"

# Money is kept exact; sums and differences stay exact decimals and are
# turned into double only for presentation.
MONEY = T.DecimalType(28, 4)   # beyond 1e14 too

SPARK_TYPES = {
    DATE: T.TimestampType(),
    STRING: T.StringType(),
    INTEGER: T.LongType(),
    FLOAT: MONEY,
    BOOLEAN: T.BooleanType(),
}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    required: bool

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.kind]


def _specs(rows: list[tuple[str, str, bool]]) -> list[ColumnSpec]:
    return [ColumnSpec(n, k, r) for n, k, r in rows]


# --- fixed values: declared extract schemas (name, type, required) ---------
ORDERS = _specs([
    ("seller_id", INTEGER, True), ("warehouse_id", INTEGER, True),
    ("store_order_id", STRING, True), ("order_release_id", STRING, True),
    ("order_line_id", STRING, True), ("seller_order_id", STRING, True),
    ("order_id_fk", STRING, True), ("core_item_id", STRING, True),
    ("created_on", DATE, True), ("style_id", INTEGER, True),
    ("seller_sku_code", STRING, True), ("sku_id", INTEGER, True),
    ("myntra_sku_code", STRING, True), ("size", STRING, True),
    ("vendor_article_number", STRING, True), ("brand", STRING, True),
    ("style_name", STRING, True), ("article_type", STRING, True),
    ("article_type_id", INTEGER, True), ("order_status", STRING, True),
    ("packet_id", STRING, True), ("seller_packe_id", INTEGER, True),
    ("courier_code", STRING, True), ("order_tracking_number", STRING, True),
    ("seller_warehouse_id", INTEGER, True),
    ("cancellation_reason_id_fk", STRING, False), ("cancellation_reason", STRING, False),
    ("packed_on", DATE, False), ("fmpu_date", DATE, False), ("inscanned_on", DATE, False),
    ("shipped_on", DATE, False), ("delivered_on", DATE, False), ("cancelled_on", DATE, False),
    ("rto_creation_date", DATE, False), ("lost_date", DATE, False),
    ("return_creation_date", DATE, False),
    ("final_amount", FLOAT, True), ("total_mrp", FLOAT, True), ("discount", FLOAT, True),
    ("coupon_discount", FLOAT, True), ("shipping_charge", FLOAT, True),
    ("gift_charge", FLOAT, True), ("tax_recovery", FLOAT, True),
    ("city", STRING, True), ("state", STRING, True), ("zipcode", STRING, True),
    ("is_ship_rel", INTEGER, True), ("upload_timestamp", DATE, True),
])

_RETURN_AMOUNTS = [
    "customer_paid_amount", "total_settlement", "total_actual_settlement",
    "amount_pending_settlement", "prepaid_commission_deduction",
    "prepaid_logistics_deduction", "prepaid_payment", "postpaid_commission_deduction",
    "postpaid_logistics_deduction", "postpaid_payment",
]

RETURNS = _specs(
    [("order_release_id", STRING, True), ("order_line_id", STRING, True),
     ("return_type", STRING, True), ("return_date", DATE, True), ("packet_id", STRING, True)]
    + [(c, FLOAT, True) for c in _RETURN_AMOUNTS]
    + [("return_id", STRING, True), ("upload_timestamp", DATE, True)]
)

# Settlement: same columns, only the first seven are required. The four
# cost columns at the end are read by the metrics, so they are declared
# here as optional (they exist in the raw settlement headers).
SETTLEMENT = _specs(
    [("order_release_id", STRING, True), ("order_line_id", STRING, True),
     ("return_type", STRING, True), ("return_date", DATE, True), ("packet_id", STRING, True),
     ("customer_paid_amount", FLOAT, True)]
    + [(c, FLOAT, False) for c in _RETURN_AMOUNTS[1:]]
    + [("return_id", STRING, False), ("upload_timestamp", DATE, True)]
    + [(c, FLOAT, False) for c in ("total_commission", "total_logistics_deduction",
                                   "tcs_amount", "tds_amount")]
)

# Columns that must be present for a row set to be usable at all.
ESSENTIAL = {
    "orders": ["order_release_id", "order_line_id", "seller_order_id", "order_status",
               "packet_id", "seller_packe_id", "created_on", "core_item_id",
               "seller_sku_code", "myntra_sku_code", "brand", "style_name",
               "order_tracking_number", "is_ship_rel", "upload_timestamp"],
    "returns": [c.name for c in RETURNS],
    "settlement": ["order_release_id", "order_line_id", "return_type", "return_date",
                   "packet_id", "customer_paid_amount", "upload_timestamp"],
}
# --- end fixed values -------------------------------------------------------

SPECS = {"orders": ORDERS, "returns": RETURNS, "settlement": SETTLEMENT}
KEY = ["order_release_id", "order_line_id"]

# Raw header names: orders extracts use spaces where the schema uses
# underscores; returns use one abbreviated header. Built by rule.
_ALIAS_EXCEPTIONS = {"returns": {"shipping_case_s": "shipping_case"}}


def header_aliases(file_type: str) -> dict[str, str]:
    """raw header -> schema name for one file type."""
    aliases = {c.name: c.name for c in SPECS[file_type]}
    if file_type == "orders":
        aliases.update({c.name.replace("_", " "): c.name for c in ORDERS})
    aliases.update(_ALIAS_EXCEPTIONS.get(file_type, {}))
    return aliases


def struct_type(file_type: str) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.spark_type, True) for c in SPECS[file_type]])


def raw_struct_type(file_type: str) -> T.StructType:
    return T.StructType([T.StructField(c.name, T.StringType(), True) for c in SPECS[file_type]])


# --- fixed values: status vocabulary ----------------------------------------
CANCELLED_NO_IMPACT = "Cancelled - No Impact"
CANCELLED_AFTER_SHIPMENT = "Cancelled - After Shipment"
RETURNED_REFUNDED = "Returned - Refunded"
RETURNED_EXCHANGED = "Returned - Exchanged"
DELIVERED_SETTLED = "Delivered - Settled"
DELIVERED_PENDING = "Delivered - Pending Settlement"
RTO_RETURNED = "RTO - Returned"
UNKNOWN_STATUS = "Unknown Status"

# Report vocabulary (status groups).
GROUP_CANCELLED = "Cancelled"
GROUP_RETURNED = "Returned"
GROUP_SETTLED = "Completed - Settled"
GROUP_PENDING = "Completed - Pending Settlement"
GROUP_UNKNOWN = "Unknown"

# Raw order_status codes and their labels.
STATUS_LABELS = {"C": "Cancelled", "D": "Delivered", "RTO": "Returned to Origin"}
RETURN_REFUND, RETURN_EXCHANGE = "return_refund", "exchange"
# --- end fixed values -------------------------------------------------------

STATUSES = [CANCELLED_NO_IMPACT, CANCELLED_AFTER_SHIPMENT, RETURNED_REFUNDED,
            RETURNED_EXCHANGED, DELIVERED_SETTLED, DELIVERED_PENDING, RTO_RETURNED,
            UNKNOWN_STATUS]
