"""schemaweave: Spark-native schema harmonisation and column matching.

Every operator takes and returns a ``DataFrame`` (or builds a ``Column``);
nothing here runs an action except the few fits that need one (scaler
statistics, ML models, bounded target lists) and the file sources that read
headers.
"""

from schemaweave.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
