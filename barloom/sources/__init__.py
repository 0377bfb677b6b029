"""Bar, market and registry sources, and the report sinks."""
