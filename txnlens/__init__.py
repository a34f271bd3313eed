"""txnlens: transaction-risk analytics as PySpark DataFrame operators."""

from txnlens.roles import Roles
from txnlens.session import build_session

__all__ = ["Roles", "build_session"]
