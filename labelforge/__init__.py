"""labelforge: semi-supervised labelling operators as Spark DataFrame jobs.

Row-local maths are higher-order functions over ``array<double>`` columns,
class- and batch-level state are small aggregated tables joined back, and
the online labeller is a Structured Streaming query.
"""

from labelforge.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
