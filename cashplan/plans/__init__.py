"""Whole jobs: the reports a store of tables yields, and the registered queries."""
