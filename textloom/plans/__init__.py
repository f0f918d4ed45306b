"""Registered queries over the library's operators, and their SQL for comparison."""
