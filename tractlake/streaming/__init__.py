"""Building tractograms from streams."""
