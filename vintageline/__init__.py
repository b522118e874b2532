"""Loan-panel credit-risk analytics expressed as Spark DataFrame operators."""
