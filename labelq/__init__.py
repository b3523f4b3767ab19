"""labelq: label-quality analytics expressed as Spark DataFrame plans.

Every operator is a function from DataFrame (or Column) to DataFrame (or Column).
Sub-packages:

- ``functions``  scalar Column builders (normalisers, parsers, prompt rendering)
- ``operators``  relational operators (agreement, metrics, ids, sampling, resolution, scoring)
- ``sources``    readers and writers (CSV edge, encoding fallback, result trees, sinks)
- ``plans``      the registered queries over the driver's tables, plus their SQL oracles
- ``streaming``  the stateless operators applied to a streaming DataFrame
"""

from labelq.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
