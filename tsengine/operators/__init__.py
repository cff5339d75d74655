"""DataFrame operators on vectors of labelled samples."""
