"""Operators on tractograms."""
