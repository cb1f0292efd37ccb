"""Training-data operators: filtering, tokenizing, de-duplication, packing and extraction at corpus scale.

Nothing else in the library imports this subpackage.
"""
