"""Training-data operators: packing, classifiers, dedup, sharding, BPE, search, rules, WARC.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()``
below are picked up by the driver entry module only when the subpackage exists.
"""
