"""Lexweave streaming."""
