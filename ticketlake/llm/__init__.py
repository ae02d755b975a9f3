"""Operators of a training-data pipeline, one module each, with their registered queries.

``QUERIES`` maps query names to functions of (spark, sf_dir); ``STATEMENTS`` holds the DuckDB
statement of those that SQL can express. Nothing outside this subpackage imports it.
"""

import importlib
import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so a worker needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES = {}
STATEMENTS = {}

for name in (
    "secret_scan",
    "token_counts",
    "toxicity",
    "url_filter",
    "nearest",
    "main_text",
    "exact_dedup",
    "mixing",
    "packing",
    "ngram_join",
    "hard_negatives",
    "alignment",
    "substring_dedup",
):
    module = importlib.import_module(f"ticketlake.llm.{name}")
    QUERIES[module.QUERY] = module.query
    if module.STATEMENT:
        STATEMENTS[module.QUERY] = module.STATEMENT
