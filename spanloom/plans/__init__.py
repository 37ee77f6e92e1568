"""Driver-side planning of runs, and the queries."""
