"""Spark-native analytics over crawl logs, web pages and text corpora."""
