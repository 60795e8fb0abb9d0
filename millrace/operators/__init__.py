"""DataFrame operators; each works on all queries, runs or seeds at once."""
