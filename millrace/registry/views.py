"""Job inputs derived from the standard tables, in SQL that Spark and DuckDB both read.

`{name}` stands for a table of the folder. No view filters rows away to be small: each is as large
as the tables under it.
"""

from __future__ import annotations

from millrace.functions.countries import SPELLINGS


def _with_price(table: str, column: str) -> str:
    """The table with `price`, a decimal(12,2) amount as text."""
    return f"(select *, cast(cast({column} as decimal(12,2)) as string) as price from {{{table}}})"


# `1,234.50` for a non-negative `price`.
_COMMA_PRICE = (
    "case when length(price) > 6 then concat(substr(price, 1, length(price) - 6), ',', "
    "substr(price, length(price) - 5)) else price end"
)


def _money(column: str) -> str:
    return f"cast({column} as decimal(12,2))"


def _day(column: str) -> str:
    return f"cast({column} as date)"


def _day_text(column: str) -> str:
    return f"cast({_day(column)} as string)"


def _spelling_rows() -> str:
    names = [name for spellings in SPELLINGS.values() for name in spellings]
    rows = [f"({i}, '{name.replace(chr(39), chr(39) * 2)}')" for i, name in enumerate(names)]
    return ", ".join(rows)


SPELLING_COUNT = sum(len(names) for names in SPELLINGS.values())
# Spark reads a doubled quote inside a literal as two adjacent literals, so quotes are spelt with chr.
_SPELLING_TABLE = _spelling_rows().replace("People''s", "People' || chr(39) || 's")

_LINE_ID = "l_orderkey * 10 + l_linenumber"
_LINE_REF = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))"

VIEWS: dict[str, str] = {}

# Products

VIEWS["product_feed"] = f"""
select p_partkey as product_id, p_name as product_name,
  case p_partkey % 4 when 0 then 'TRUE' when 1 then 'true' when 2 then ' True ' else 'FALSE' end
    as is_active,
  {_money("p_retailprice")} as base_price
from {{part}}
"""

VIEWS["promotions"] = """
select p_partkey as product_id, cast((p_size % 6) * 0.05 as decimal(4,2)) as discount_pct
from {part} where p_type <> 'ECONOMY'
"""

VIEWS["order_lines"] = f"""
select {_LINE_ID} as order_line_id, l_partkey as product_id, cast(l_quantity as int) as quantity
from {{lineitem}}
"""

# Sales and orders

VIEWS["sales_transactions"] = f"""
select {_LINE_ID} as transaction_id, concat('STORE-', cast(l_suppkey as string)) as store_id,
  {_day("l_shipdate")} as sale_date, p_type as product_category,
  {_money("l_extendedprice")} as revenue, cast(l_quantity as int) as quantity
from {{lineitem}} join {{part}} on l_partkey = p_partkey
"""

VIEWS["store_sales"] = f"""
select concat('STORE-', cast(l_suppkey as string)) as store_id, {_day("l_shipdate")} as sale_date,
  {_LINE_ID} as transaction_id, l_partkey as product_id, {_money("l_extendedprice")} as revenue
from {{lineitem}}
"""

VIEWS["discount_amount_orders"] = f"""
select o_orderkey as order_id, concat('CUST-', cast(o_custkey as string)) as customer_id,
  case when o_orderpriority = '5-LOW' then null else {_money("o_totalprice")} end as order_amount,
  cast((o_custkey % 5) * 0.05 as decimal(4,2)) as discount_pct
from {{orders}}
"""

VIEWS["regional_orders"] = f"""
select o_orderkey as order_id, r_name as region_code, {_money("o_totalprice")} as order_amount,
  'legacy' as region_code_legacy
from {{orders}} join {{customer}} on o_custkey = c_custkey
  join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
"""

VIEWS["text_discount_orders"] = f"""
select concat('O-', cast(o_orderkey as string)) as order_id, {_money("o_totalprice")} as order_total,
  case o_orderpriority when '1-URGENT' then '10' when '2-HIGH' then ' 5 ' when '3-MEDIUM' then 'N/A'
    when '4-NOT SPECIFIED' then case o_orderstatus when 'F' then '1_5' when 'O' then '10.5' else '' end
    else case o_orderstatus when 'F' then null when 'O' then '+20' else '0' end end
    as discount_pct_str
from {{orders}}
"""

VIEWS["plain_orders"] = f"""
select o_orderkey as order_id, o_custkey as customer_id, {_money("o_totalprice")} as order_total
from {{orders}}
"""

# Customers

VIEWS["dim_customer"] = """
select c_custkey as customer_id, 'bronze' as customer_tier, c_mktsegment as signup_region,
  c_custkey as _ingest_seq
from {customer}
union all
select c_custkey, 'gold', c_mktsegment, c_custkey + 1000000000 from {customer} where c_acctbal > 5000
"""

VIEWS["customers_global"] = """
select c_custkey as customer_id, concat(' ', c_name, ' ') as customer_name,
  concat('N', cast(c_nationkey as string)) as country
from {customer}
union all
select c_custkey, c_name, concat('N', cast(c_nationkey as string)) from {customer} where c_acctbal < 0
"""

VIEWS["customer_summaries"] = f"""
select c_custkey as customer_id,
  case c_mktsegment when 'BUILDING' then 'gold' when 'FURNITURE' then 'silver'
    when 'MACHINERY' then 'bronze' else 'guest' end as customer_tier,
  max(case when o_orderdate >= timestamp '1999-01-01 00:00:00' then {_money("o_totalprice")} end)
    as avg_order_value,
  cast(count(o_orderkey) as int) as orders_last_year
from {{customer}} left join {{orders}} on c_custkey = o_custkey
group by c_custkey, c_mktsegment
"""

VIEWS["customer_activity"] = """
select c_custkey as customer_id,
  case c_mktsegment when 'AUTOMOBILE' then 'free' when 'BUILDING' then 'Basic'
    when 'FURNITURE' then 'PREMIUM' when 'HOUSEHOLD' then 'enterprise' else 'trial' end
    as subscription_tier,
  cast(31 - extract(day from max(ts)) as int) as days_since_last_login,
  cast(sum(case event_type when 'error' then 1 when 'view' then 0 end) as int)
    as support_tickets_opened_90d,
  cast(coalesce(sum(case when event_type = 'error' and value < 5 then 1 else 0 end), 0) as int)
    as payment_failures_90d
from {customer} left join {events} on c_custkey = user_id
group by c_custkey, c_mktsegment
"""

VIEWS["customer_ages"] = """
select concat('C', cast(c_custkey as string)) as customer_id,
  case when c_mktsegment = 'MACHINERY' then null else cast(18 + c_custkey % 60 as int) end as age,
  c_name as customer_name, c_acctbal as total_spend_12mo
from {customer}
"""

VIEWS["customer_emails"] = """
select c_custkey as customer_id,
  case c_mktsegment when 'MACHINERY' then null
    when 'HOUSEHOLD' then concat('user', cast(c_custkey as string))
    when 'BUILDING' then concat('user', cast(c_custkey as string), '@build.example.com@old')
    else concat('user', cast(c_custkey as string), '@', lower(c_mktsegment), '.example.com') end
    as email
from {customer}
"""

VIEWS["customer_contacts"] = """
select c_custkey as customer_id,
  case c_nationkey % 6
    when 0 then concat('98765', lpad(cast(c_custkey % 100000 as string), 5, '0'))
    when 1 then concat('07911 ', lpad(cast(c_custkey % 1000000 as string), 6, '0'))
    when 2 then concat('(202) 555-', lpad(cast(c_custkey % 10000 as string), 4, '0'))
    when 3 then concat('0170-', lpad(cast(c_custkey % 1000000 as string), 6, '0'))
    when 4 then concat('+61 4 ', lpad(cast(c_custkey % 100000000 as string), 8, '0'))
    else concat('0', cast(c_custkey as string)) end as raw_phone,
  case c_nationkey % 6 when 0 then 'IN' when 1 then 'GB' when 2 then ' us ' when 3 then 'DE'
    when 4 then 'AU' else 'FR' end as country_code
from {customer}
"""

VIEWS["overdue_accounts"] = """
select concat('ACC', cast(c_custkey as string)) as account_id,
  case when c_nationkey % 5 = 1 then 'domestic' else 'international' end as region,
  c_custkey % 60 as days_overdue
from {customer}
"""

VIEWS["risk_snapshot"] = f"""
select concat('ACC', cast(c_custkey as string)) as account_id,
  case c_mktsegment when 'BUILDING' then 'vip' when 'MACHINERY' then null when 'HOUSEHOLD' then ''
    else 'standard' end as tier,
  cast(({_money("c_acctbal")} - 4500) * 0.1 as decimal(12,3)) as discrepancy
from {{customer}}
"""

# Reconciliation and balances

VIEWS["transactions"] = f"""
select concat('TXN', cast(event_id as string)) as transaction_id,
  concat('ACC', cast(user_id as string)) as account_id,
  cast(case event_type when 'signup' then null when 'error' then -1 * {_money("value")}
    else {_money("value")} end as decimal(12,2)) as amount,
  case event_type when 'error' then 'refund' else 'charge' end as txn_type,
  {_day_text("ts")} as txn_date
from {{events}}
"""

VIEWS["ledger"] = f"""
select concat('ACC', cast(c_custkey as string)) as account_id,
  {_money("c_acctbal")} as ledger_balance, c_mktsegment <> 'MACHINERY' as is_active
from {{customer}}
"""

VIEWS["balances"] = f"""
select c_custkey as customer_id, {_money("c_acctbal")} as balance from {{customer}}
"""

VIEWS["region_history"] = """
select c_custkey as customer_id, r_name as region, c_mktsegment <> 'BUILDING' as is_current
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
union all
select c_custkey, 'FORMER', false from {customer} where c_acctbal < 0
"""

VIEWS["balance_changes"] = f"""
select user_id * 20 as customer_id, {_money("value")} as change_amount from {{events}}
"""

VIEWS["journey_events"] = """
select case when event_type in ('view', 'click', 'error') then 'UNKNOWN_CUSTOMER'
    else concat('C', cast(user_id as string)) end as customer_id,
  event_id as event_seq, concat(event_type, ':', cast(event_id as string)) as payload
from {events}
"""

# CRM accounts

VIEWS["crm_accounts_raw"] = f"""
select concat(' A', cast(c_custkey as string)) as account_id, concat(c_name, ' ') as account_name,
  case c_mktsegment when 'AUTOMOBILE' then ' software ' when 'BUILDING' then 'RETAIL'
    when 'FURNITURE' then 'Healthcare' when 'HOUSEHOLD' then 'fiNANce' else ' manufacturing' end
    as industry,
  concat(' n', cast(c_nationkey % 5 as string)) as billing_country,
  cast({_money("c_acctbal")} + 1000 as string) as annual_revenue,
  cast(1 + c_custkey % 5000 as string) as employee_count,
  cast(date '2020-01-01' + cast(c_custkey % 1500 as int) as string) as created_date,
  concat('Team ', cast(c_nationkey % 3 as string), ' ') as owner_team
from {{customer}}
union all
select concat('A', cast(c_custkey as string), ' '), concat('Z ', c_name), 'RETAIL', 'zz', '1.00', '1',
  '2024-02-29', 'Team Z'
from {{customer}} where c_acctbal < 1000
"""

VIEWS["crm_tiers_raw"] = """
select concat('A', cast(c_custkey as string)) as account_id,
  case c_custkey % 6 when 0 then ' gOLD ' when 1 then 'SILVER' when 2 then 'bronze'
    when 3 then 'Platinum' when 4 then null else '' end as tier,
  case c_custkey % 4 when 0 then '2024-03-01' when 1 then '2023-11-15' when 2 then 'soon' end
    as tier_since,
  case c_custkey % 5 when 0 then '2026-10-01' when 1 then '2026-12-31' when 2 then '2026-09-30'
    when 3 then '2027-01-01' else 'n/a' end as renewal_date,
  case c_custkey % 3 when 0 then ' 9.999 ' when 1 then '71.5' else 'high' end as health_score,
  case c_custkey % 7 when 0 then ' YES ' when 1 then 'true' when 2 then '1' when 3 then 'No'
    when 4 then 'FALSE' when 5 then '0' else 'maybe' end as is_strategic,
  case c_nationkey % 4 when 0 then 'North' when 1 then ' South ' when 2 then '  ' end
    as region_owner_team
from {customer} where c_acctbal > 500
union all
select concat(' A', cast(c_custkey as string), ' '), 'Silver', '2022-01-01', '2026-11-11', '50', 'yes',
  'West'
from {customer} where c_acctbal > 7000
"""

# Procurement

VIEWS["suppliers_raw"] = f"""
select concat(' SP', cast(s_suppkey as string)) as supplier_id, concat(s_name, ' ') as supplier_name,
  case s_nationkey % 5 when 0 then 'USA' when 1 then ' US ' when 2 then 'United States'
    when 3 then 'Canada' else ' Deutschland' end as country,
  concat('City ', cast(s_nationkey as string)) as city,
  case s_suppkey % 3 when 0 then 'Logistics' when 1 then 'IT services ' else 'Facilities' end
    as category,
  case s_suppkey % 4 when 0 then 'Net 45' when 1 then '2/10 Net 30' when 2 then ' Net 60 '
    else 'On receipt' end as payment_terms,
  cast(date '2018-01-01' + cast(s_suppkey % 2000 as int) as string) as onboarded_date,
  case s_suppkey % 6 when 0 then 'yes' when 1 then '1' when 2 then ' TRUE ' when 3 then 'no'
    when 4 then '' else 'false' end as is_preferred,
  {_COMMA_PRICE} as annual_contract_value,
  case s_nationkey % 9 when 0 then 'usd' when 1 then 'GBP' when 2 then 'EUR' when 3 then ' inr '
    when 4 then 'JPY' when 5 then 'AED' when 6 then 'cad' when 7 then 'AUD' else 'XXX' end as currency
from {_with_price("supplier", "abs(s_acctbal)")}
union all
select concat('SP', cast(s_suppkey as string), ' '), concat('repeat of ', s_name), 'Japan', 'City', 'Other',
  'Net 10', '2017-01-01', 'no', '1.00', 'USD'
from {{supplier}} where s_acctbal < 2000
"""

VIEWS["purchase_orders_raw"] = f"""
select concat('PO', {_LINE_REF}) as po_id,
  case when l_returnflag = 'N' and l_linenumber = 7 then 'SP-none'
    else concat(' SP', cast(l_suppkey as string)) end as supplier_id,
  {_day_text("l_shipdate")} as po_date, {_COMMA_PRICE} as amount,
  case l_partkey % 9 when 0 then 'usd' when 1 then 'GBP' when 2 then 'EUR' when 3 then ' inr '
    when 4 then 'JPY' when 5 then 'AED' when 6 then 'cad' when 7 then 'AUD' else 'XXX' end as currency,
  case when l_returnflag = 'R' then 'Cancelled' when l_linestatus = 'O' then ' open ' else 'Received' end
    as status,
  concat('Buyer ', cast(l_suppkey % 4 as string)) as buyer_team,
  concat(cast(cast(l_quantity as int) as string), ' ') as line_items, 'HQ' as delivery_site
from {_with_price("lineitem", "l_extendedprice")}
"""

# Billing

VIEWS["billing_accounts_raw"] = """
select concat('A', cast(c_custkey as string), ' ') as account_id, c_name as account_name,
  case c_nationkey % 5 when 0 then ' us' when 1 then 'GB ' when 2 then 'de' when 3 then 'IN'
    else 'AU' end as country,
  concat(' ', c_mktsegment) as industry, '2020-01-01' as signup_date
from {customer}
union all
select concat('A', cast(c_custkey as string)), concat('z', c_name), 'ZZ', 'other', '2021-01-01'
from {customer} where c_acctbal < 0
"""

VIEWS["plans_raw"] = f"""
select concat('P', cast(p_size as string)) as plan_id, p_name as plan_name,
  case p_size % 4 when 0 then 'Starter' when 1 then ' growth' when 2 then 'BUSINESS'
    else 'enterprise' end as tier,
  case when p_size % 3 = 0 then 'Annual' else 'monthly ' end as billing_period,
  {_COMMA_PRICE} as list_price, 'USD' as currency
from {_with_price("part", "p_retailprice")}
"""

VIEWS["subscriptions_raw"] = f"""
select concat('S', cast(o_orderkey as string)) as subscription_id,
  concat('A', cast(o_custkey as string)) as account_id,
  concat(' P', cast(1 + o_orderkey % 52 as string)) as plan_id,
  {_day_text("o_orderdate")} as start_date,
  case when o_orderstatus = 'F' then cast({_day("o_orderdate")} + cast(o_custkey % 400 as int) as string)
    else ' ' end as end_date,
  cast(1 + o_custkey % 40 as string) as seats, cast((o_orderkey % 5) * 5 as string) as discount_pct,
  case when o_orderstatus = 'F' then 'Cancelled' else 'ACTIVE ' end as status
from {{orders}}
union all
select concat('S', cast(o_orderkey as string), ' '), 'A-late', 'P1', '2099-01-01', '', '1', '0', 'active'
from {{orders}} where o_orderpriority = '1-URGENT'
"""

VIEWS["invoices_raw"] = f"""
select concat('I', cast(o_orderkey as string)) as invoice_id,
  concat(' A', cast(o_custkey as string)) as account_id,
  concat('S', cast(o_orderkey as string)) as subscription_id,
  case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then 'Credit_Note' else ' Invoice' end
    as invoice_type,
  case when o_orderpriority = '5-LOW' and o_orderstatus = 'P'
    then concat('I', cast(o_custkey as string)) else ' ' end as credit_for,
  {_day_text("o_orderdate")} as issue_date,
  cast({_day("o_orderdate")} + 30 as string) as due_date,
  {_COMMA_PRICE} as amount,
  case o_orderkey % 5 when 0 then 'usd' when 1 then 'EUR' when 2 then ' gbp' when 3 then 'INR'
    else 'AUD' end as currency
from {_with_price("orders", "o_totalprice")}
union all
select concat('I', cast(o_orderkey as string), ' '), 'A-late', '', 'invoice', '', '2099-01-01', '', '1', 'USD'
from {{orders}} where o_orderpriority = '2-HIGH'
"""

VIEWS["payments_raw"] = f"""
select concat('PM', {_LINE_REF}) as payment_id, concat(' I', cast(l_orderkey as string)) as invoice_id,
  {_day_text("l_shipdate")} as paid_date, {_COMMA_PRICE} as amount,
  case l_orderkey % 5 when 0 then 'usd' when 1 then 'EUR' when 2 then ' gbp' when 3 then 'INR'
    else 'AUD' end as currency
from {_with_price("lineitem", "l_extendedprice")}
"""

# Shipping

VIEWS["carrier_feed"] = f"""
select concat('F', {_LINE_REF}) as feed_row_id, concat('SH', {_LINE_REF}) as shipment_ref,
  concat('WH', lpad(cast(1 + l_suppkey % 12 as string), 2, '0')) as warehouse_code,
  case l_partkey % 4 when 0 then 'Northwind Freight' when 1 then 'Kestrel Express'
    when 2 then 'Harbor Line' else 'Atlas Parcel' end as carrier_name,
  {_day_text("l_shipdate")} as shipped_at,
  case when l_returnflag = 'N' then ''
    else cast({_day("l_shipdate")} + cast(cast(l_quantity as int) % 7 as int) as string) end
    as delivered_at,
  case l_linenumber % 3 when 0 then price
    when 1 then concat({_COMMA_PRICE}, ' kg')
    else concat(cast(cast(l_quantity as int) * 950 as string), ' g') end as weight,
  case l_linenumber % 3 when 0 then price
    else concat('$', {_COMMA_PRICE}) end as freight_charge
from {_with_price("lineitem", "l_extendedprice")}
"""

# Countries

VIEWS["country_customers_raw"] = f"""
select concat('CU', cast(c_custkey as string)) as customer_id, c_name as customer_name,
  c_mktsegment as segment,
  case c_custkey % 3 when 0 then concat(chr(9), spelling, chr(10)) when 1 then concat(' ', spelling)
    else spelling end as country,
  concat('City ', cast(c_nationkey as string)) as city,
  cast(date '2025-01-01' + cast(c_custkey % 365 as int) as string) as signed_up_on,
  cast({_money("c_acctbal")} as string) as credit_limit,
  case when c_custkey % 7 = 0 then 'false' else 'true' end as is_active
from {{customer}} join (values {_SPELLING_TABLE}) as s(n, spelling) on c_custkey % {SPELLING_COUNT} = n
"""

VIEWS["country_orders_raw"] = f"""
select concat('OR', cast(o_orderkey as string)) as order_id,
  concat('CU', cast(o_custkey as string)) as customer_id,
  {_day_text("o_orderdate")} as ordered_on,
  case o_orderpriority when '1-URGENT' then 'Electronics' when '2-HIGH' then 'Home' else 'Sports' end
    as product_category,
  cast(1 + o_orderkey % 5 as string) as quantity,
  cast({_money("o_totalprice")} as string) as amount,
  case o_orderstatus when 'F' then 'Web' when 'O' then 'Store' else 'Partner' end as channel,
  concat(spelling, ' ') as country
from {{orders}} join (values {_SPELLING_TABLE}) as s(n, spelling) on o_custkey % {SPELLING_COUNT} = n
"""
