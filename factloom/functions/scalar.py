"""Pure functions by name, over decimal texts and typed columns, and their use in expressions such as (i64_to_string (product_i64 …))."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.terms import Var

REGISTRY: dict[str, Callable[..., Column]] = {}

for _name, _type in {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "f32": "float", "f64": "double"}.items():
    REGISTRY[f"{_name}_from_string"] = lambda x, t=_type: x.cast(t)
    REGISTRY[f"{_name}_to_string"] = lambda x: x.cast("string")
    REGISTRY[f"sum_{_name}"] = lambda *xs, t=_type: reduce(lambda a, b: (a + b).cast(t), xs)
    REGISTRY[f"product_{_name}"] = lambda *xs, t=_type: reduce(lambda a, b: (a * b).cast(t), xs)
    REGISTRY[f"sub_{_name}"] = lambda a, b, t=_type: (a - b).cast(t)
    REGISTRY[f"tanh_{_name}"] = lambda x, t=_type: F.tanh(x).cast(t)
    REGISTRY[f"min_{_name}"] = lambda *xs: F.least(*xs)
    REGISTRY[f"max_{_name}"] = lambda *xs: F.greatest(*xs)


def register(name: str, function: Callable[..., Column]) -> None:
    """Adds a function of columns; plain and pandas UDFs will do."""
    REGISTRY[name] = function


def expression(term) -> Column:
    """The column of a parsed expression; variables are columns, other symbols texts."""
    if isinstance(term, Var):
        return F.col(f"`{term.name}`")
    if isinstance(term, tuple):
        name, *args = term
        if name not in REGISTRY:
            raise ValueError(f"no function {name}")
        return REGISTRY[name](*map(expression, args))
    return F.lit(term)


def tanh_prime(x: Column) -> Column:
    return 1 - F.tanh(x) * F.tanh(x)
