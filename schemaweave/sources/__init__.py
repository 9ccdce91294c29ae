"""Sources and sinks (S1-S9)."""
