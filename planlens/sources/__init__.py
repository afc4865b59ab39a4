"""Sources, fixed dimensions and sinks."""
