"""duelframe: the data side of preference optimization as Spark DataFrame operators."""

from duelframe.session import build_session, materialize, shared_folder

__all__ = ["build_session", "materialize", "shared_folder"]
