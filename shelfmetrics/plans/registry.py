"""Registry of the named queries: function name -> (function, title)."""
from collections.abc import Callable

QUERIES: dict[str, tuple[Callable, str]] = {}


def query(title: str):
    def add(fn: Callable) -> Callable:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = (fn, title)
        return fn
    return add
