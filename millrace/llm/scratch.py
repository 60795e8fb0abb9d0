"""Tables that an operator writes to cut a lineage or to use a result twice; see ``millrace.sources.shared``."""

from pyspark.sql import DataFrame

from ..sources.shared import release, scope, shared_folder, written

__all__ = ["free_names", "release", "scope", "shared_folder", "written"]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column already."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
