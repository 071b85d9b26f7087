"""Training-data operators: ANN search, near-dedup, scans, sharding, mixing, encoding.

Nothing outside this subpackage imports it. ``quern.llm.queries`` registers the
``opN_*`` queries; each operator lives in a module of its own with a general
interface.
"""
