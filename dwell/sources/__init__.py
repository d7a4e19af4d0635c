"""Sources and sinks: the rental-table binding, readers/writers and table contracts."""
