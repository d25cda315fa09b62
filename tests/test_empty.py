"""Every operator on empty inputs: no error, zero counts, empty breakdowns."""

import datetime as dt

from settlekit import schema as S
from settlekit.operators import anomaly as AN
from settlekit.operators import metrics as M
from settlekit.operators import quality as QA
from settlekit.operators import track as T
from settlekit.operators.analyze import analyze
from settlekit.plans import reports as RP

RUN = dt.datetime(2025, 3, 31)


def test_operators_on_an_empty_run(spark):
    orders = spark.createDataFrame([], S.struct_type("orders"))
    returns = spark.createDataFrame([], S.struct_type("returns"))
    settlements = spark.createDataFrame([], S.struct_type("settlement"))
    a = analyze(orders, returns, settlements, None, RUN, order_col=None)
    assert a.count() == 0
    s = M.summary_row(a).first()
    assert s.total_orders == 0 and s.settlement_rate == 0.0 and s.net_profit_loss == 0.0 and s.aov is None
    for df in [M.status_counts(a), M.monthly_orders(a), M.profit_histogram(a), M.brand_counts(a),
               M.sku_return_rate(a), T.resolution_rates(a), T.brand_trends(a), AN.anomalies(a)]:
        assert df.count() == 0
    assert M.report_ratios(a).first().avg_profit_per_settled == 0.0
    np_ = T.new_pending(a, a, "2025-03")
    rs = T.newly_resolved(a, a, "2025-03")
    assert np_.count() == 0 and rs.count() == 0 and T.resolution_patterns(rs).count() == 0
    assert T.settlement_report(a, np_, rs, "2025-03").where("metric = 'total_pending_settlements'") \
        .first().value == 0.0
    comp = QA.completeness({"orders": orders, "returns": returns})
    assert comp.where("completeness <> 0").count() == 0
    errors = QA.validation_errors({"orders": orders})
    score = QA.quality_score(comp, errors, QA.orphans(returns, orders), QA.orphans(settlements, orders)).first()
    assert score.quality_score == 0.0 and score.orphaned_records == 0
    lines = RP.recon_report(a, np_, rs, "2025-03").where("text like 'Total Orders:%'").first()
    assert lines.text == "Total Orders: 0"
    assert AN.anomaly_kpis(AN.anomalies(a), a).first().anomaly_rate == 0.0
