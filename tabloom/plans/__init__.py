"""Models of tables, the end-to-end façade, and the registered queries."""
