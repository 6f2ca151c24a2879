"""Graph sources and sinks: edge-list files, converters, generators, result tables."""
