"""Queries over the star-schema tables; importing a module registers its queries."""

from tessella.plans import basic, meshes, registry, solving

__all__ = ["basic", "meshes", "registry", "solving"]
