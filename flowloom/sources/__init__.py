"""Readers of packets, payloads, captures and stored snapshots."""
