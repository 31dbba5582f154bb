"""Operators that turn a crawl into training data. Nothing outside this folder imports it."""
