"""Lexweave sources."""
