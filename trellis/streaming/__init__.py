"""Job states and the drop-folder runner."""
