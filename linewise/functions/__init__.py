"""Column expressions."""

from linewise.functions.text import *  # noqa: F401,F403
