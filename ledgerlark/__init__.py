"""Ledgerlark: series statistics and news-curation queues as pure Spark DataFrame functions."""
