"""Servers over an engine: PostgreSQL's wire protocol, and tools by JSON-RPC."""
