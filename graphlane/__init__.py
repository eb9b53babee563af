"""Graph analytics on Spark DataFrames: types, a catalogue of operators, conversions, readers and writers."""

from graphlane import operators  # noqa: F401
from graphlane.convert import assert_equal, convert
from graphlane.errors import ConvergenceError
from graphlane.registry import CONFIG, algorithm, algos, describe, list_algorithms, list_types, plan, run, solve_algorithm
from graphlane.types import BipartiteGraph, EdgeMap, EdgeSet, Graph, Matrix, NodeLabels, NodeMap, NodeSet, Vector

__all__ = ["CONFIG", "BipartiteGraph", "ConvergenceError", "EdgeMap", "EdgeSet", "Graph", "Matrix", "NodeLabels", "NodeMap", "NodeSet", "Vector", "algorithm", "algos", "assert_equal", "convert", "describe", "list_algorithms", "list_types", "plan", "run", "solve_algorithm"]
