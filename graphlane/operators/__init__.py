"""The catalogue: importing this package registers every operator."""

from graphlane.operators import bipartite, centrality, clustering, embedding, flow, subgraph, traversal, utility  # noqa: F401
