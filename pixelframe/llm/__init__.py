"""Training-data operators: formatting, cleaning, deduplication, scoring, tokenising and packing.

Nothing outside this subpackage imports it.  Executors import it too (the
Arrow functions are pickled by reference), so ship the package with
``--py-files`` or install it on every worker.
"""
