"""Spark jobs and queries over corpora of app packages."""
