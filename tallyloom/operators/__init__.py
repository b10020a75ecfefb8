"""DataFrame operators: joins to dimensions and lookups, merges of facts, order and top, probes."""
