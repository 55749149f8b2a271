"""Ready-made reports and the rule registry (2.H)."""
