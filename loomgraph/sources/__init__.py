"""Sources and sinks: stores, table projections, source-tree discovery, extraction."""
