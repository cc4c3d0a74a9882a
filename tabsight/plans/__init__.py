"""Working views, the full run, and the registered queries."""
