"""Training-data operators: ten large-corpus components, each in its own module.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
