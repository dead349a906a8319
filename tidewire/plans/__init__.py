"""Chains of operators: article processing, the report, the daily job."""
