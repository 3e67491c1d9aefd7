"""Reports come back in their final order, with ties broken by a unique key."""

import pytest

from retentia.plans import registry

SF = "/root/testdata/sf0.001"
NEWEST_FIRST = {"One-Time Buyer (97%)": 2, "Repeat Customer (3%)": 1}
ORDERS = {
    "monthly_trends": lambda r: r.purchase_month,
    "state_pareto": lambda r: (-r.total_revenue, r.state),
    "rfm_diagonal": lambda r: -int(r.rfm_segment[0]),
    "rfm_hybrid": lambda r: (r.action_priority, -r.monetary, r.customer_unique_id),
    "reviews_one_time_vs_repeat": lambda r: NEWEST_FIRST[r.customer_type],
    "top_categories_side_by_side": lambda r: r.rank,
    "handoff_by_segment": lambda r: (-r.avg_handoff_days, r.segment),
    "category_loyalty": lambda r: (-r.repeat_rate_percentage, r.product_category_name_english),
    "purchase_window_distribution": lambda r: (-r.customers, r.helper),
    "churn_status": lambda r: (-r.customers, r.customer_status),
    "dup_keys_payment_orders": lambda r: (r.occurrences, r.order_id),
    "multi_method_payments": lambda r: (r.order_id, r.payment_sequential),
}


@pytest.mark.parametrize("key", sorted(ORDERS))
def test_final_order(spark, key):
    rows = registry.queries()[key](spark, SF).collect()
    assert rows == sorted(rows, key=ORDERS[key])
