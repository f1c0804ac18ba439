"""Call-failure diagnosis on PySpark."""

from callcause.profile import Columns, Profile

__all__ = ["Columns", "Profile"]
