"""Tidewire: news-signal analytics as Spark DataFrame operators."""
