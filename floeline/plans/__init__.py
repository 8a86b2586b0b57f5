"""Compositions of operators: the ETL, the live status, the dashboard, the query registry."""
