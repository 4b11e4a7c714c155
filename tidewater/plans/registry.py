"""Named queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from tidewater.plans import q_context, q_joins, q_portfolio, q_prices, q_reports, q_signals, q_streaming

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (q_prices, q_joins, q_signals, q_context, q_portfolio, q_reports, q_streaming):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
