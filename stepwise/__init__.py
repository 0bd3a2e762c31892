"""stepwise: Spark-native analytics for per-entity, per-step observation data.

Every public operator takes DataFrames plus column names (usually through a
:class:`~stepwise.roles.Roles` object) and returns a DataFrame, so planning and
execution stay inside Catalyst.
"""

from stepwise.roles import Roles
from stepwise.session import get_session, checkpoint_dir

__all__ = ["Roles", "get_session", "checkpoint_dir"]
