"""Lexweave: detection, anonymisation and analysis of sensitive text on Spark DataFrames."""
