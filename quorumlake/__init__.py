"""Certified selective prediction over multi-site tables, as Spark jobs."""
