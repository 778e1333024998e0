"""Query catalogue: whole plans over the stored tables, with SQL of the same meaning."""
