"""Sources and sinks: text folders, custom graphs, stores and exports."""
