"""Operators on the texts of prompts, answers and documents. Nothing outside this package imports it."""
