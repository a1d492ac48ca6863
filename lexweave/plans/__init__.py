"""Lexweave plans."""
