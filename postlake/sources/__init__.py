"""Readers of landed board payloads, snapshot tables and exports."""
