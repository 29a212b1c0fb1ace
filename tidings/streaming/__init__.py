"""The same operators over payloads as they land."""
