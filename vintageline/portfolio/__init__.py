"""Portfolio tables built on scored panels: term structure, staging, loss, reasons, segments."""
