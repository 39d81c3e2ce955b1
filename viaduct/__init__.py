"""Spark-first analytics over corpora of video-derived records."""
