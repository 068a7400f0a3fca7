"""Declared schemas of the source tables; nothing is inferred."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "erp_orders_daily": (
        "source_row_id string, date date, region string, product_line string, units_shipped double, units_returned double, "
        "gross_sales double, discounts double, list_price double, gross_margin_pct double, "
        "monthly_subscription_revenue double, deferred_delta double, shipped_orders int, ingested_at timestamp"
    ),
    "erp_refunds_daily": (
        "source_row_id string, date date, region string, product_line string, refunds double, refund_liability_inr double, ingested_at timestamp"
    ),
    "erp_price_list": "effective_from date, product_line string, list_price double, discount_policy_note string",
    "mkt_campaign_weekly": (
        "week_start date, campaign_id string, region string, channel string, spend_inr double, impressions long, ingested_at timestamp"
    ),
    "ops_dispatch_events": (
        "event_id string, ts_raw string, warehouse string, region string, promised_hours double, actual_hours double, "
        "employee_id string, shift_id string, staff_productivity_score double"
    ),
    "ops_support_tickets_daily": (
        "date date, region string, ticket_category string, complaint_tickets int, total_tickets int, shipped_orders_hint int, "
        "customer_email string, ticket_body string, ingested_at timestamp"
    ),
    "ext_competitor_promo": "date date, product_line string, promo_active int, observed int, source_note string",
}
NATURAL_KEYS: dict[str, tuple[str, ...]] = {
    "erp_orders_daily": ("date", "region", "product_line"),
    "erp_refunds_daily": ("date", "region", "product_line"),
    "mkt_campaign_weekly": ("week_start", "campaign_id", "region"),
    "ops_dispatch_events": ("event_id",),
    "ops_support_tickets_daily": ("date", "region", "ticket_category"),
    "ext_competitor_promo": ("date", "product_line"),
}
