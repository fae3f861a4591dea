"""The registered queries, the SQL they are checked against, and the views both read."""
