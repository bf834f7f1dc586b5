"""Importing this module registers the queries of all catalogues."""

from . import catalog_bands  # noqa: F401
from . import catalog_noise  # noqa: F401
from . import catalog_spectral  # noqa: F401
from . import catalog_cluster  # noqa: F401
from . import catalog_stats  # noqa: F401
from . import catalog_geo  # noqa: F401
from . import catalog_atmosphere  # noqa: F401
from . import catalog_sources  # noqa: F401
from . import catalog_geometry  # noqa: F401
from . import catalog_tables  # noqa: F401
from . import catalog_aerosol  # noqa: F401
from . import catalog_products  # noqa: F401
