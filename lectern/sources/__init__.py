"""Sources and sinks: test tables, landed JSON pages, the vector index."""
