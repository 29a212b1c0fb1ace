"""Scans: configuration, landed payloads of each kind, prompt text, archives and published digests."""
