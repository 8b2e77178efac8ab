"""CRM accounts and their tiers: raw text to the account summary."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import count_where, mean_decimal, sum_where
from millrace.functions.text import blank_to_null, lenient, title_case, upper_code, yes_no
from millrace.operators.joins import enrich
from millrace.operators.keyed import first_per_trimmed_key

# Fixed values.
INDUSTRIES = ["Software", "Retail", "Healthcare", "Finance", "Manufacturing"]
TIERS = ["Gold", "Silver", "Bronze"]
NO_TIER = "Unassigned"
Q4_FIRST, Q4_LAST = date(2026, 10, 1), date(2026, 12, 31)

ACCOUNT_COLUMNS = [
    "account_id",
    "account_name",
    "industry",
    "billing_country",
    "annual_revenue",
    "employee_count",
    "created_date",
    "owner_team",
]
TIER_COLUMNS = [
    "tier",
    "tier_since",
    "renewal_date",
    "health_score",
    "is_strategic",
    "region_owner_team",
]


def clean_crm_accounts(raw: DataFrame) -> DataFrame:
    """One typed row per account, the first by name. Malformed numbers and dates raise."""
    one = first_per_trimmed_key(raw.select(*ACCOUNT_COLUMNS), "account_id", ["account_name"])
    return one.select(
        "account_id",
        F.trim("account_name").alias("account_name"),
        title_case("industry").alias("industry"),
        upper_code("billing_country").alias("billing_country"),
        F.col("annual_revenue").cast("decimal(14,2)").alias("annual_revenue"),
        F.col("employee_count").cast("int").alias("employee_count"),
        F.to_date("created_date").alias("created_date"),
        F.trim("owner_team").alias("owner_team"),
    )


def clean_tiers(raw: DataFrame) -> DataFrame:
    """One typed row per account, the newest `tier_since` text first. Unreadable values become null,
    unknown tiers `Unassigned`."""
    newest = [F.col("tier_since").desc_nulls_last(), F.col("tier")]
    one = first_per_trimmed_key(raw.select("account_id", *TIER_COLUMNS), "account_id", newest)
    tier = title_case("tier")
    return one.select(
        "account_id",
        F.when(tier.isin(TIERS), tier).otherwise(NO_TIER).alias("tier"),
        lenient("tier_since", "date").alias("tier_since"),
        lenient("renewal_date", "date").alias("renewal_date"),
        lenient("health_score", "decimal(5,2)").alias("health_score"),
        yes_no("is_strategic").alias("is_strategic"),
        blank_to_null("region_owner_team").alias("region_owner_team"),
    )


def add_tiers(accounts: DataFrame, tiers: DataFrame) -> DataFrame:
    """Accounts with their tier fields; an account without a record is `Unassigned`."""
    joined = enrich(
        accounts.select(*ACCOUNT_COLUMNS),
        tiers.select("account_id", *TIER_COLUMNS),
        ["account_id"],
    )
    filled = joined.withColumn("tier", F.coalesce("tier", F.lit(NO_TIER)))
    return filled.select(*ACCOUNT_COLUMNS, *TIER_COLUMNS)


def account_summary(
    accounts: DataFrame, renewals_from: date = Q4_FIRST, renewals_to: date = Q4_LAST
) -> DataFrame:
    """Account totals per industry and country, revenue per tier, renewals of one quarter."""
    revenue = F.col("annual_revenue")
    renewing = F.col("renewal_date").between(F.lit(renewals_from), F.lit(renewals_to))
    per_tier = [
        sum_where(F.col("tier") == tier, revenue)
        .cast("decimal(16,2)")
        .alias(f"revenue_{tier.lower()}")
        for tier in [*TIERS, NO_TIER]
    ]
    return accounts.groupBy("industry", "billing_country").agg(
        F.count("*").alias("accounts_count"),
        F.sum(revenue).cast("decimal(16,2)").alias("total_revenue"),
        mean_decimal(revenue, "decimal(14,2)").alias("avg_revenue"),
        F.sum("employee_count").cast("bigint").alias("total_employees"),
        F.min("created_date").alias("first_created"),
        F.max("created_date").alias("last_created"),
        count_where(F.col("is_strategic")).alias("strategic_accounts"),
        *per_tier,
        count_where(renewing).alias("renewals_q4"),
        F.coalesce(sum_where(renewing, revenue), F.lit(0))
        .cast("decimal(16,2)")
        .alias("renewal_revenue_q4"),
        F.countDistinct("region_owner_team").alias("region_owner_teams"),
    )
