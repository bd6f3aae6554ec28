"""Reading flow records."""
