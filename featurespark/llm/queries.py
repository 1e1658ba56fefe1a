"""All queries of the subpackage and their SQL, by name."""

from importlib import import_module

MODULES = ["chat", "conversations", "decontaminate", "importance", "language", "licenses", "minhash", "packing", "pii", "quality", "token_counts", "toxicity", "warc"]

QUERIES = {}
ORACLES = {}
for _name in MODULES:
    _module = import_module(f"featurespark.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
