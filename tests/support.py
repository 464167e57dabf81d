"""Helpers that several test modules import; no ``conftest`` is imported by name."""


def rows(df, *columns, digits=6):
    """Rows as sorted tuples with rounded numbers."""
    def cell(v):
        return round(v, digits) + 0.0 if isinstance(v, float) else v

    picked = df.select(*columns) if columns else df
    return sorted((tuple(cell(v) for v in r) for r in picked.collect()), key=str)
