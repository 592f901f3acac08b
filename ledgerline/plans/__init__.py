"""Contracts and the registered queries."""
