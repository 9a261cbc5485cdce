"""Streaming entry points.

The matching pipelines are batch work: no operator of the inventory keeps state across time,
uses a watermark or handles late data. What carries over to Structured Streaming is the
row-local part (text cleaning, combined features, pair features), because those are plain
column expressions; ``offers.py`` applies them to a streaming DataFrame and lands each
micro-batch idempotently.
"""
