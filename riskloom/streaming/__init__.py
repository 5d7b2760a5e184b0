"""Continuous runs over a feed of releases; batch runs need none of this."""
