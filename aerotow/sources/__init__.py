"""Sources and sinks: driver tables, stand-in fixtures, files."""
