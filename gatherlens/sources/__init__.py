"""Entity scans and parsers, lookup tables, sinks, and driver-table stand-ins."""
