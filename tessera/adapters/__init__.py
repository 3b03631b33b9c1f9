"""Thin surfaces over the engine: a command line and JSON-RPC over text lines."""
