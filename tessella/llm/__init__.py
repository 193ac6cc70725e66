"""Training-data pipeline operators.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
