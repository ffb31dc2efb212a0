"""tessera: raster map algebra as Spark DataFrame plans."""

import sys

from .layer import Georef, Layer, LayerMeta, TileLayer

__all__ = ["Georef", "Layer", "LayerMeta", "TileLayer"]

# Ship the package's Python code (mapInArrow kernels, the GeoTIFF data source)
# to Python workers by value, so executors need not have tessera installed.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # older cloudpickle: workers must import tessera themselves
    pass
