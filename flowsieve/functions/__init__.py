"""Column expressions; nothing in here runs a job."""
