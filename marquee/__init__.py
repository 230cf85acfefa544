"""Listing reconciliation and text-corpus preparation as Spark DataFrame jobs."""
