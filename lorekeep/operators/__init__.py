"""DataFrame operators of the catalog: filters, joins, upserts, audits."""
