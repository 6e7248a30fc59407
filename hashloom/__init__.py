"""hashloom: keyed-table analytics (upsert, lookup, joins, k-mers, statistics) on Spark."""
