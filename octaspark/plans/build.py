"""The flagship plan: points to octree, voxels and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octaspark.functions.geometry import morton
from octaspark.operators import octree, voxelize
from octaspark.operators.octree import TreeSpec
from octaspark.staging import few, written


@dataclass
class LodTree:
    """DataFrames of one tree. Cell counts, nodes and the cells' leaves are written to the shared folder; points
    are read again where they are used, and not shuffled to find their leaf unless there are very many cells."""

    spec: TreeSpec
    points: DataFrame  # with ix, iy, iz, key, leaf_level, leaf_key
    nodes: DataFrame  # level, key, n, is_leaf

    @classmethod
    def of(cls, points: DataFrame, spec: TreeSpec) -> LodTree:
        indexed = octree.with_fine_index(points, spec)
        cells = written(octree.cell_counts(indexed), "cells")
        nodes = written(octree.nodes(cells, spec), "nodes")
        home = few(written(octree.homes(cells, spec, nodes), "homes"))
        return cls(spec, octree.at_home(indexed, home), nodes)

    def voxel_counts(self) -> DataFrame:
        """level, key and num_voxels of inner nodes."""
        found = voxelize.occupancy(self.points, self.spec)
        return found.select("level", morton(*[F.col(f"n{a}") for a in "xyz"]).alias("key"), "num_voxels")

    def voxels(self, strategy: str = "average") -> DataFrame:
        return voxelize.voxels(self.points, self.spec, strategy)
