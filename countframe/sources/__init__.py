from countframe.sources.io import (  # noqa: F401
    describe,
    fit_or_load,
    read_counts,
    read_latent,
    write_latent,
    write_report,
)
from countframe.sources.tables import table  # noqa: F401
