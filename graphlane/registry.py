"""The catalogue of operators: registration, checked dispatch, plans."""

from __future__ import annotations

import functools
import inspect
import warnings
from collections.abc import Callable

from graphlane import types

ALGORITHMS: dict[str, "Algorithm"] = {}
#: Every implementation of a path by its name; ALGORITHMS has the one that is used without a choice.
IMPLEMENTATIONS: dict[str, dict[str, "Algorithm"]] = {}
#: log_plans, log_conversions: print what is called or converted; allow_conversion: arguments may lose values or weights that an operator
#: doesn't ask for, else that is a TypeError; unknown_version, outdated_version: what happens when an implementation
#: registers a version that the path's own one lacks or has passed: raise, warn or ignore.
CONFIG = {"log_plans": False, "log_conversions": False, "allow_conversion": True, "unknown_version": "warn", "outdated_version": "ignore"}
DEFAULT = "dataframe"
_CHECKED = {name: getattr(types, name) for name in ("Graph", "BipartiteGraph", "NodeSet", "NodeMap", "EdgeSet", "EdgeMap", "Vector", "Matrix")}


class Algorithm:
    def __init__(self, path: str, func: Callable, requires: dict[str, dict], version: int, impl: str = DEFAULT) -> None:
        self.path, self.func, self.requires, self.version, self.impl = path, func, requires, version, impl
        self.signature = inspect.signature(func)
        functools.update_wrapper(self, func)

    def check(self, *args, **kwargs) -> inspect.BoundArguments:
        """TypeError if an argument is of the wrong kind or lacks a property that the operator needs."""
        bound = self.signature.bind(*args, **kwargs)
        bound.apply_defaults()
        for name, value in bound.arguments.items():
            said = self.signature.parameters[name].annotation
            said = said.__name__ if isinstance(said, type) else str(said)
            kinds = tuple(kind for n, kind in _CHECKED.items() if n in {x.strip() for x in said.split("|")})
            if kinds and not isinstance(value, kinds) and CONFIG["allow_conversion"] and (less := _reduced(value, kinds)) is not None:
                if CONFIG["log_conversions"]:
                    print(f"{self.path}: {name} from {type(value).__name__} to {type(less).__name__}")
                bound.arguments[name] = value = less
            if kinds and not isinstance(value, kinds) and not (value is None and "None" in said) and not (isinstance(value, list) and "list" in said):
                raise TypeError(f"{self.path}: {name} must be {said}, not {type(value).__name__}")
            if said == "NodeID" and (isinstance(value, bool) or not isinstance(value, int)):
                raise TypeError(f"{self.path}: {name} must be a node id (int), not {type(value).__name__}")
            for prop, allowed in self.requires.get(name, {}).items():
                allowed = allowed if isinstance(allowed, tuple) else (allowed,)
                if (has := getattr(value, prop)) not in allowed:
                    raise TypeError(f"{self.path}: {name} must have {prop} in {allowed}, it has {has!r}")
        return bound

    def __call__(self, *args, impl: str | None = None, **kwargs):
        """impl: the name of the implementation to use; KeyError if the path has none of that name."""
        if impl is not None and impl != self.impl:
            return IMPLEMENTATIONS[self.path][impl](*args, **kwargs)
        bound = self.check(*args, **kwargs)
        if CONFIG["log_plans"]:
            print(f"{self.path}{self.signature}")
        return self.func(*bound.args, **bound.kwargs)

    def describe(self) -> dict:
        return {"path": self.path, "version": self.version, "implementations": sorted(IMPLEMENTATIONS[self.path]), "signature": str(self.signature), "requires": self.requires, "doc": inspect.getdoc(self.func)}


def _reduced(value, kinds: tuple[type, ...]):
    """value without what kinds don't hold: a node map as a node set, an edge map or a graph as an edge set; else None."""
    if isinstance(value, types.NodeMap) and types.NodeSet in kinds:
        return types.NodeSet(value.df, unique=True)
    if isinstance(value, types.EdgeMap) and types.EdgeSet in kinds:
        return types.EdgeSet(value.df, "src", "dst", is_directed=value.is_directed, check=False)
    if isinstance(value, types.Graph):
        if types.EdgeMap in kinds and value.edge_type == "map":
            return value.edge_map()
        if types.EdgeSet in kinds:
            return value.edge_set()
        if types.NodeSet in kinds:
            return types.NodeSet(value.nodes, unique=True)
    return None


def _told(action: str, message: str) -> None:
    if action == "raise":
        raise ValueError(message)
    if action == "warn":
        warnings.warn(message, stacklevel=3)


def algorithm(path: str, version: int = 0, impl: str = DEFAULT, **requires: dict):
    """Registers a function under a path; requires: for a parameter, the properties that its argument must have.

    Of the default implementation a higher version replaces a lower one. Another impl stands beside it and is used where it
    is asked for (impl=); its version is held against that of the default one."""

    def register(func: Callable) -> Algorithm:
        found = Algorithm(path, func, requires, version, impl)
        if impl == DEFAULT or path not in ALGORITHMS:
            if path not in ALGORITHMS or ALGORITHMS[path].version <= version:
                ALGORITHMS[path] = found
                IMPLEMENTATIONS.setdefault(path, {})[impl] = found
            return found
        known = ALGORITHMS[path].version
        if version > known:
            _told(CONFIG["unknown_version"], f"{path} has no version {version} that {impl} could implement")
        elif version < known:
            _told(CONFIG["outdated_version"], f"{impl} implements version {version} of {path}, which has version {known}")
        IMPLEMENTATIONS[path][impl] = found
        return found

    return register


class Namespace:
    """Dotted access to the catalogue: algos.centrality.pagerank(g)."""

    def __init__(self, prefix: str = "", plan: bool = False) -> None:
        self._prefix, self._plan = prefix, plan

    def __getattr__(self, name: str):
        path = f"{self._prefix}{name}"
        if path in ALGORITHMS:
            return functools.partial(_plan_of, path) if self._plan else ALGORITHMS[path]
        if any(p.startswith(f"{path}.") for p in ALGORITHMS):
            return Namespace(f"{path}.", self._plan)
        raise AttributeError(f"no operator {path}")

    def __dir__(self):
        return sorted({p[len(self._prefix) :].split(".")[0] for p in ALGORITHMS if p.startswith(self._prefix)})


def run(path: str, *args, impl: str | None = None, **kwargs):
    if path not in ALGORITHMS:
        raise KeyError(path)
    return ALGORITHMS[path](*args, impl=impl, **kwargs)


for _kind in _CHECKED.values():  # graph.run("centrality.pagerank") is run("centrality.pagerank", graph)
    _kind.run = lambda self, path, *args, **kwargs: run(path, self, *args, **kwargs)


def _plan_of(path: str, *args, **kwargs) -> dict:
    """The checked signature and, where the operator is a single plan, Spark's physical plan of each result."""
    ALGORITHMS[path].check(*args, **kwargs)
    result = ALGORITHMS[path](*args, **kwargs)
    parts = result if isinstance(result, tuple) else (result,)
    frames = [f for p in parts for f in ((p.nodes, p.edges) if isinstance(p, types.Graph) else (getattr(p, "df", None),)) if f is not None]
    return ALGORITHMS[path].describe() | {"plans": [f._jdf.queryExecution().executedPlan().toString() for f in frames]}


def list_algorithms() -> list[str]:
    return sorted(ALGORITHMS)


def describe(path: str) -> dict:
    return ALGORITHMS[path].describe()


def list_types() -> dict[str, list[str]]:
    """The kinds of objects and, of each, those it can be reduced to where an operator asks for less."""
    return {"Graph": ["EdgeMap", "EdgeSet", "NodeSet"], "BipartiteGraph": [], "NodeSet": [], "NodeMap": ["NodeSet"], "EdgeSet": [], "EdgeMap": ["EdgeSet"], "Vector": [], "Matrix": []}


def solve_algorithm(path: str, *args, **kwargs) -> dict:
    """Whether the operator takes these arguments, without running it: its description, each argument's kind and what it
    would be reduced to, and the error's text if it does not."""
    found = ALGORITHMS[path]
    out = found.describe() | {"arguments": {}, "error": None}
    try:
        given = found.signature.bind(*args, **kwargs).arguments
        bound = found.check(*args, **kwargs)
        out["arguments"] = {name: {"given": type(value).__name__, "used": type(bound.arguments[name]).__name__} for name, value in given.items()}
    except TypeError as e:
        out["error"] = str(e)
    return out


algos, plan = Namespace(), Namespace(plan=True)
