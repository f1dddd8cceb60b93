"""What a change-point run is asked for: family, penalty, adjustment, pruning; all checks of arguments."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

CLOSED = ("mean", "variance", "meanvariance", "exponential", "mgaussian")
REGRESSION = ("gaussian", "binomial", "poisson", "lasso", "quantile")
SEQUENTIAL = ("ar", "var", "arma", "ma", "arima", "garch")
DERIVED = ("rank", "kcp")
FAMILIES = (*CLOSED, *REGRESSION, *SEQUENTIAL, *DERIVED, "custom")
ALIASES = {"lm": "gaussian", "mv": "meanvariance", "ts": "arima", "logistic": "binomial"}
UNPRUNED = ("mgaussian", "lasso", "garch")


@dataclass(frozen=True)
class Spec:
    """A validated request; see `make`."""

    family: str
    order: tuple[int, ...] = ()
    beta: str | float = "MBIC"
    adjustment: str = "MBIC"
    pruning: float | str | None = None
    trim: float = 0.0
    segment_count: int = 10
    vanilla: float = 0.0
    epsilon: float = 1e-10
    momentum: float = 0.0
    line_search: tuple[float, ...] = (1.0,)
    lower: tuple[float, ...] | None = None
    upper: tuple[float, ...] | None = None
    epochs: Callable[[int], int] | None = None
    warm_start: bool = False
    variance: object = None
    responses: int = 1
    tau: float = 0.5
    include_mean: bool = False
    features: int = 100
    bandwidth: float | None = None
    seed: int = 0
    parameters: int | None = None
    cost: Callable | None = None
    batch_cost: Callable | None = None
    gradient: Callable | None = None
    hessian: Callable | None = None
    cp_only: bool = False
    extra: dict = field(default_factory=dict)


def _whole(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer()


def check_order(family: str, order: Sequence[int] | int | None) -> tuple[int, ...]:
    """The order as a tuple, or a ValueError that says what the family needs."""
    given = () if order is None else (order,) if isinstance(order, (int, float)) else tuple(order)
    if family in SEQUENTIAL and not given:
        raise ValueError(f"family {family!r} needs an order")
    if not all(_whole(x) for x in given):
        raise ValueError("the order holds whole numbers")
    given = tuple(int(x) for x in given)
    if family == "ar":
        if len(given) not in (1, 3) or given[0] <= 0 or any(given[1:]):
            raise ValueError("the order of an AR model is one positive number, or (p, 0, 0)")
        return given[:1]
    if family == "var" and (len(given) != 1 or given[0] <= 0):
        raise ValueError("the order of a VAR model is one positive number")
    if family == "ma":
        given = given[-1:] if len(given) in (1, 2, 3) and not any(given[:-1]) else (-1,)
        if given[0] <= 0:
            raise ValueError("the order of an MA model is one positive number, or (0, 0, q)")
    if family in ("arma", "garch") and (len(given) != 2 or min(given) < 0 or not any(given)):
        raise ValueError(f"the order of family {family!r} is two numbers from 0, not both 0")
    if family == "arima" and (len(given) != 3 or min(given) < 0 or not any(given)):
        raise ValueError("the order of an ARIMA model is three numbers from 0, not all 0")
    return given


def cost_arity(cost: Callable) -> int:
    """1 for a cost of a segment, 2 for a cost of a segment and parameters."""
    n = sum(p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in inspect.signature(cost).parameters.values())
    if n not in (1, 2):
        raise ValueError("a cost takes (data) or (data, theta)")
    return n


def make(family: str, order=None, **options) -> Spec:
    """A `Spec` after all checks."""
    name = family.lower() if isinstance(family, str) else family
    name = ALIASES.get(name, name)
    if name not in FAMILIES:
        raise ValueError(f"the family must be one of {', '.join(FAMILIES)}; got {family!r}")
    adjustment = options.pop("cost_adjustment", options.pop("adjustment", "MBIC"))
    adjustment = "BIC" if adjustment is None else adjustment
    if adjustment not in ("BIC", "MBIC", "MDL"):
        raise ValueError("cost_adjustment must be one of BIC, MBIC, MDL")
    beta = options.pop("beta", "MBIC")
    if isinstance(beta, str) and beta not in ("BIC", "MBIC", "MDL"):
        raise ValueError("beta must be a number or one of BIC, MBIC, MDL")
    cost, gradient, hessian = (options.get(k) for k in ("cost", "gradient", "hessian"))
    if name == "custom":
        if cost is None and options.get("batch_cost") is None:
            raise ValueError("family 'custom' needs a cost")
        if options.get("batch_cost") is not None and gradient is not None:
            raise ValueError("a batch_cost takes no gradient")
        if (gradient is None) != (hessian is None):
            raise ValueError("a gradient and a hessian go together")
        if cost is not None and cost_arity(cost) == 2 and gradient is None:
            raise ValueError("a cost of (data, theta) needs a gradient and a hessian")
        if cost is not None and cost_arity(cost) == 1 and gradient is not None:
            raise ValueError("a cost of (data) takes no gradient")
    elif cost is not None or gradient is not None or hessian is not None or options.get("batch_cost") is not None:
        raise ValueError(f"family {name!r} has its own cost")
    tau = options.get("tau", 0.5)
    if name == "quantile" and not 0 < tau < 1:
        raise ValueError("tau is between 0 and 1")
    if not 0 <= options.get("trim", 0.0) < 0.5:
        raise ValueError("trim is from 0 to below 0.5")
    if not 0 <= options.get("vanilla", 0.0) <= 1:
        raise ValueError("vanilla is from 0 to 1")
    if name in ("kcp",) and "beta" not in options and adjustment == "MBIC" and "cost_adjustment" not in options:
        adjustment = "BIC"
    options = {k: tuple(v) if k in ("line_search", "lower", "upper") and v is not None else v for k, v in options.items()}
    return Spec(family=name, order=check_order(name, order), beta=beta, adjustment=adjustment, **options)


def parameter_count(spec: Spec, d: int) -> int:
    """Parameters of a segment for data of d columns (after lag embedding for ar and var)."""
    f, o = spec.family, spec.order
    if spec.parameters is not None:
        return spec.parameters
    return {
        "mean": d,
        "rank": d,
        "kcp": d,
        "exponential": d,
        "variance": d * d,
        "meanvariance": d * d + d,
        "garch": sum(o) + 1,
        "arma": sum(o) + 1,
        "ma": sum(o) + 1,
        "arima": (o[0] + o[-1] + 1 + spec.include_mean) if o else 0,
        "mgaussian": (d - spec.responses) * spec.responses,
        "var": (o[0] if o else 0) * spec.responses**2,
    }.get(f, d - 1)


def penalty(beta: str | float, p: int, n: int) -> float:
    """The penalty of one more change."""
    if not isinstance(beta, str):
        return float(beta)
    return {"BIC": (p + 1) * math.log(n) / 2, "MBIC": (p + 2) * math.log(n) / 2, "MDL": (p + 2) * math.log2(n) / 2}[beta]


def pruning_constant(spec: Spec, p: int) -> float:
    """What a candidate's excess over the least cost is held against, besides beta; -inf keeps all candidates."""
    if spec.pruning == "exact":
        return -math.inf
    if spec.pruning is not None:
        return float(spec.pruning)
    start = -math.inf if spec.family in (*UNPRUNED, "var") else 0.0
    return start + {"BIC": 0.0, "MBIC": p * math.log(2), "MDL": float(p)}[spec.adjustment]


__all__ = ["Spec", "make", "parameter_count", "penalty", "pruning_constant", "check_order", "cost_arity", "replace", "FAMILIES"]
