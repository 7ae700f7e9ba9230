"""Typed requests and the driver-facing queries."""
