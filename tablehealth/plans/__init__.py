"""End-to-end jobs, table bindings and the query registry."""
