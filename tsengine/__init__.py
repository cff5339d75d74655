"""A PySpark-native engine for labelled time series, with operations on training text beside it."""
