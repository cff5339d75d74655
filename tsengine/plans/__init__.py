"""From query text to a lazy DataFrame: durations, syntax, compiler and engine."""
