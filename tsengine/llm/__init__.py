"""Operations on training text: deduplication, classification, decontamination, packing and token output.

Nothing else in the library imports this subpackage; `queries.py` registers what the entry module offers.
"""
