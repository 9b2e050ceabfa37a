"""Spark-first labelling engine for tiled 3-D scans."""
