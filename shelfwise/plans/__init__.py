"""Multi-step pipelines composed from sources, operators and sinks."""
