"""Daily transactions against the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import match

# Fixed value: only refunds may be negative.
AMOUNT_RULE = "txn_type = 'refund' OR amount >= 0"
REPORT_COLUMNS = ["account_id", "txn_total", "ledger_balance", "discrepancy"]


def drop_null_amounts(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.col("amount").isNotNull())


def reconcile_ledger(transactions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Transaction total against ledger balance per active account.

    Transactions are summed before the join. Only active ledger accounts are reported, which also
    leaves out accounts the ledger does not have, so the join is inner.
    """
    totals = transactions.groupBy("account_id").agg(F.sum("amount").alias("txn_total"))
    active = ledger.where(F.col("is_active")).select("account_id", "ledger_balance")
    gap = F.col("txn_total") - F.col("ledger_balance")
    return match(totals, active, ["account_id"]).withColumn("discrepancy", gap).select(*REPORT_COLUMNS)


def recon_summary(report: DataFrame) -> DataFrame:
    gap = F.col("discrepancy")
    return report.agg(
        F.count("*").alias("accounts_checked"),
        F.sum(F.when(gap != 0, 1).otherwise(0)).alias("accounts_with_discrepancy"),
        F.sum(gap).alias("net_discrepancy"),
        F.avg(F.abs(gap)).alias("avg_abs_discrepancy"),
    )
