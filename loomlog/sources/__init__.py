"""Where messages come from and where the log is kept."""
