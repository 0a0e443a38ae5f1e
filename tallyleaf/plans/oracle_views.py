"""SQL definitions of the domain tables, for the side-by-side check in a second engine."""

from __future__ import annotations

import re

from tallyleaf import fixed_values as fv
from tallyleaf.sources import views as v


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in values) + "]"


def sql_rows(rows) -> str:
    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, (int, float)):
            return repr(x)
        return "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows)


_audit_case = " ".join(f"WHEN event_type = '{k}' THEN '{a}'" for k, a in v.AUDIT_ACTIONS.items())

VIEWS = {
    "ev": """SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events""",
    "usage": f"""SELECT user_id % 20 AS tenant_id, event_id AS request_id, ts,
        ({sql_list(v.USAGE_MODELS)})[user_id % 4 + 1] AS model, k * 100 AS input_tokens,
        CAST(floor(value * 10) AS BIGINT) AS output_tokens, event_type <> 'error' AS success,
        event_type AS scenario, value AS latency_ms FROM ev""",
    "tenants": f"""SELECT tenant_id, 'tenant-' || tenant_id AS tenant_name,
        ({sql_list(v.TIERS)})[tenant_id % 5 + 1] AS tier,
        CASE WHEN tenant_id % 7 = 0 THEN 'suspended' ELSE 'active' END AS status,
        ({sql_list(v.MODES)})[(tenant_id // 5) % 4 + 1] AS mode,
        CAST(CASE WHEN tenant_id % 3 = 0 THEN 20 ELSE 0 END AS DECIMAL(12,2)) AS discount
        FROM (SELECT DISTINCT user_id % 20 AS tenant_id FROM events)""",
    "prices": "SELECT model, CAST(price_in AS DECIMAL(10,6)) AS price_in, CAST(price_out AS DECIMAL(10,6)) AS "
    "price_out FROM (VALUES " + sql_rows([(m, a, b) for m, (a, b) in fv.MODEL_PRICES.items()])
    + ") AS t(model, price_in, price_out)",
    "packages": "SELECT tier, CAST(fee AS DECIMAL(12,2)) AS fee, CAST(quota AS BIGINT) AS quota, CAST(rate AS "
    "DECIMAL(10,6)) AS rate FROM (VALUES " + sql_rows([(t, *r) for t, r in fv.PACKAGES.items()])
    + ") AS t(tier, fee, quota, rate)",
    "quotas": "SELECT * FROM (VALUES " + sql_rows([(t, *r) for t, r in fv.TIER_QUOTAS.items()])
    + ") AS t(tier, base_rpm, base_tpm, elastic_rpm, elastic_tpm, burst_rpm, burst_tpm)",
    "priced": """SELECT u.*, u.input_tokens + u.output_tokens AS total_tokens,
        ROUND((CAST(u.input_tokens AS DECIMAL(18,0)) * COALESCE(p.price_in, CAST(0 AS DECIMAL(10,6)))
             + CAST(u.output_tokens AS DECIMAL(18,0)) * COALESCE(p.price_out, CAST(0 AS DECIMAL(10,6))))
             * CAST(0.001 AS DECIMAL(4,3)), 6) AS cost_usd
        FROM usage u LEFT JOIN prices p ON u.model = p.model""",
    "monthly": """SELECT tenant_id, strftime(ts, '%Y%m') AS period, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        count(*) AS call_count, count(*) FILTER (NOT success) AS failed_count, sum(cost_usd) AS cost_usd,
        ROUND(sum(cost_usd) * CAST(7.2 AS DECIMAL(4,2)), 4) AS cost_cny FROM priced GROUP BY 1, 2""",
    "requests": """SELECT event_id AS request_id, ts, user_id % 20 AS tenant_id, '/' || event_type AS endpoint,
        value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 + k % 4 ELSE 200 END AS status_code FROM ev""",
    "audit": f"""SELECT event_id AS audit_id, ts, user_id % 20 AS tenant_id, user_id,
        CASE WHEN k % 10 = 0 THEN 'data.export' {_audit_case} END AS action,
        CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status FROM ev""",
    "doc_lines": """SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "regions": """SELECT doc_id, pos AS region_id, text, (pos % 3) * 200 + doc_id % 7 AS x1,
        (pos // 3) * 30 + (pos * 7) % 11 AS y1, (pos % 3) * 200 + doc_id % 7 + 20 + length(text) % 230 AS x2,
        (pos // 3) * 30 + (pos * 7) % 11 + 18 + pos % 25 AS y2,
        ((doc_id * 31 + pos * 17) % 100) / 100.0::DOUBLE AS confidence FROM doc_lines""",
    "part_fields": """SELECT p_partkey AS doc_id, p_type AS category, unnest(['brand', 'product_name', 'specification',
        'package_type']) AS field, unnest([p_brand, p_name, p_size || 'ml', p_type]) AS value,
        unnest([0, 1, 2, 3]) AS i FROM part""",
    "ocr": """SELECT doc_id, category, field, value,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (50 + doc_id % 50) / 100.0::DOUBLE END AS conf
        FROM part_fields WHERE (doc_id + i) % 7 <> 0""",
    "vl": """SELECT doc_id, category, field,
        CASE WHEN (doc_id + i) % 6 = 0 THEN upper(value) WHEN (doc_id + i) % 6 = 3 THEN reverse(value)
             WHEN (doc_id + i) % 9 = 1 THEN value || ' pack of twelve' WHEN (doc_id + i) % 9 = 4 THEN 'Zq'
             ELSE value END AS value,
        CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (50 + doc_id % 40) / 100.0::DOUBLE END AS conf
        FROM part_fields WHERE (doc_id + i) % 5 <> 0""",
    "shelf": """SELECT l_orderkey * 10 + l_linenumber AS item_id, l_partkey, l_returnflag, l_linestatus,
        CAST(l_shipdate AS DATE) AS production_date, CAST(l_quantity AS INT) AS life FROM lineitem""",
    "shelf_status": f"""SELECT *, make_date(
            CAST(year(production_date) + (month(production_date) + life - 1) // 12 AS BIGINT),
            CAST((month(production_date) + life - 1) % 12 + 1 AS BIGINT),
            CAST(least(day(production_date), 28) AS BIGINT)) AS expiry_date FROM shelf""",
    "shelf_days": f"""SELECT *, datediff('day', DATE '{v.SHELF_ASOF}', expiry_date) AS days_to_expiry,
        CASE WHEN expiry_date < DATE '{v.SHELF_ASOF}' THEN 'expired'
             WHEN datediff('day', DATE '{v.SHELF_ASOF}', expiry_date) <= 30 THEN 'near_expiry'
             ELSE 'valid' END AS status FROM shelf_status""",
    "txn": """SELECT o_orderkey AS txn_id, o_custkey AS counterparty, o_totalprice AS amount,
        o_orderstatus AS status FROM orders""",
    "watch": "SELECT c_custkey AS counterparty FROM customer WHERE c_acctbal < 0",
    "lnodes": """SELECT conv_id * 1000 + turn AS node_id, conv_id AS run_id, conv_id % 20 AS tenant_id,
        role AS node_type, turn FROM conversations""",
    "ledges": """SELECT a.node_id AS src, a.node_id + 1 AS dst, a.run_id FROM lnodes a
        WHERE a.node_id + 1 IN (SELECT node_id FROM lnodes)""",
    "wh_events": "SELECT event_id, ts, user_id % 20 AS tenant_id, event_type FROM ev",
    "wh_subs": """SELECT s_suppkey AS sub_id, s_suppkey % 20 AS tenant_id,
        CASE s_suppkey % 3 WHEN 0 THEN ['click', 'purchase'] WHEN 1 THEN ['error']
             ELSE ['view', 'signup', 'error'] END AS events, s_acctbal >= 0 AS active FROM supplier""",
    "wh_attempts": """SELECT event_id // 6 AS delivery_id, event_id % 6 + 1 AS attempt,
        (event_id // 6) % 20 AS tenant_id, ts, k % 4 = 0 AS success, value AS duration_ms FROM ev""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_view(name)

    def visit_view(name: str) -> None:
        for other in VIEWS:
            if other != name and other not in needed and re.search(rf"\b{other}\b", VIEWS[name]):
                visit_view(other)
        if name not in needed:
            needed.append(name)

    visit(body)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, " + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, " + body[len("WITH"):]
    return f"WITH {ctes} {body}"
