"""Plan building blocks: staging, size-bounded lookups, the query catalog."""
