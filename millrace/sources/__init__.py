"""Sources and sinks: connectors, versioned datasets, file sets, synthetic rows, a JSON catalog."""
