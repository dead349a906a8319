"""Column-to-column functions; nothing here triggers a job or a Python worker."""
