"""Relational steps: staging, periods, KPIs, ledger, rules, comparison."""
