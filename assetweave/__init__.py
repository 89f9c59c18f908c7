"""assetweave: media-asset indexing and similarity search as Spark plans.

The public functions are in the subpackages: ``functions`` (column expressions), ``operators`` (plans
from DataFrame to DataFrame), ``sources`` (listings, decoders, the store), ``plans`` (indexing and
commands) and ``streaming``.
"""

__version__ = "0.1.0"
