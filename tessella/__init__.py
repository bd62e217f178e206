"""tessella: fields, particles and adaptive block meshes as Spark DataFrames.

Sub-packages
------------
``operators``  cell kernels, stencils, joins, reductions, refinement, particles, solvers
``sources``    parameter decks, snapshots, history and histogram files, diffs
``functions``  scalar column functions, catalogue of variables and their flags
``plans``      queries over the star-schema tables with their SQL equivalents
``streaming``  cadence windows and consecutive-vote state
"""

__version__ = "0.1.0"
