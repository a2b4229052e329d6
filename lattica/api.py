"""All verbs and functions in one namespace: ``import lattica.api as la``.

Names such as ``filter``, ``map`` and ``slice`` stand for the verbs here, so import the module, not its names.
"""

from lattica.core import clean_names, is_blank, is_missing, resolve_cols, with_row_id  # noqa: F401
from lattica.functions import dates, listops, numeric, parsing, recode, rowwise, text, windows
from lattica.operators import checks, eda, groups, joins, reshape, rows, sets, verbs

_MODULES = (verbs, rows, joins, groups, sets, reshape, eda, checks, text, recode, parsing, dates, numeric, windows, rowwise, listops)


def _own(module) -> dict:
    """The public functions that a module defines, aliases included."""
    return {name: f for name, f in vars(module).items() if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == module.__name__}


for _module in _MODULES:
    globals().update(_own(_module))
