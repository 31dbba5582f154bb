"""Stage plans, report tables and the query registry."""
