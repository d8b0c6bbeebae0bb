"""Density-based spatial clustering of n-dimensional points on DataFrames.

>>> from gridloom import Params, density_clusters, points_of
>>> labelled = density_clusters(points_of(df, "id", ["x", "y"]), Params(eps=0.03, min_pts=50))
"""

from gridloom.params import Params
from gridloom.plans.clustering import density_clusters
from gridloom.sources.points import points_of, read_points

__all__ = ["Params", "density_clusters", "points_of", "read_points"]
