"""Streams: event ingest, daily counts, quotas per key."""
